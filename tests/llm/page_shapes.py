"""Pages for testing text extraction, made apart from the generator that the model is trained on.

Templates are written by hand after common kinds of sites; wordings are whole English sentences. Each
template yields the html and the article's blocks.
"""

import random

SENTENCES = """The council met on Monday and voted to keep the library open until the end of next year.
Heavy rain closed two of the bridges over the river, and buses were sent another way.
She said that the results were better than anyone in the group had hoped for.
Add the flour slowly, stirring all the time, until the mixture is smooth.
Prices rose by three percent in the first quarter, the bank reported.
Why did the engineers choose steel for the second tower?
The museum holds letters, maps and photographs from four generations of one family.
Nobody was hurt, but the fire destroyed most of the stock.
Install the package, restart the service and check the log for warnings.
It took the climbers nine days to reach the northern ridge.
Critics called the film slow; audiences loved it all the same!
Each student reads one chapter a week and writes a short summary of it.
The patch fixes a rare crash when a file is renamed while it is being read.
Winter wheat is sown in October and cut in late July.
After the war the harbour was rebuilt and the old market moved inland.
Two witnesses saw the car turn left without stopping at the light.""".split("\n")
TITLES = ["Library stays open", "Rain closes bridges", "A short history of the harbour", "How to bake bread", "Release notes for version four", "On the northern ridge", "Notes on winter wheat", "What the critics missed"]
MENU = ["Home", "News", "Sport", "About us", "Contact", "Shop", "Archive", "Videos", "Weather", "Jobs"]
SMALL = ["Subscribe to our newsletter today.", "This site uses cookies to improve your visit.", "Buy two shirts and get one free.", "All content is protected. Terms apply.", "Great piece, thanks for writing it!", "I disagree with the second point."]


def _blocks(r, least=1, most=7):
    return [" ".join(r.choice(SENTENCES) for _ in range(r.randint(1, 5))) for _ in range(r.randint(least, most))]


def _list(r, n=6):
    return "<ul>" + "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(r.sample(MENU, n))) + "</ul>"


def news(r):
    title, blocks = r.choice(TITLES), _blocks(r)
    body = f"<h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in blocks)
    page = f'<html><head><title>{title} | The Paper</title></head><body><header class="masthead"><a href="/">The Paper</a></header><nav>{_list(r)}</nav><main><article>{body}</article></main><aside><h2>Most read</h2>{_list(r, 4)}</aside><footer><p>{r.choice(SMALL)}</p></footer></body></html>'
    return page, [title, *blocks]


def blog(r):
    title, blocks = r.choice(TITLES), _blocks(r)
    said = "".join(f'<li class="comment"><p>{r.choice(SMALL)}</p></li>' for _ in range(r.randint(1, 4)))
    body = f"<h2>{title}</h2>" + "".join(f"<p>{b}</p>" for b in blocks)
    page = f'<html><body><div id="header"><h1>My days</h1></div><div id="content"><div class="post">{body}</div><div id="comments"><h3>Comments</h3><ol>{said}</ol></div></div><div id="sidebar"><h3>Archive</h3>{_list(r, 5)}</div><div id="footer">{r.choice(SMALL)}</div></body></html>'
    return page, [title, *blocks]


def manual(r):
    title, first, steps, last = r.choice(TITLES), _blocks(r, 1, 2), [r.choice(SENTENCES) for _ in range(r.randint(2, 5))], _blocks(r, 1, 2)
    inner = f"<h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in first) + "<ol>" + "".join(f"<li>{x}</li>" for x in steps) + "</ol>" + "".join(f"<p>{b}</p>" for b in last)
    page = f'<!doctype html><html><body><nav class="toc">{_list(r, 7)}</nav><main role="main"><section>{inner}</section></main><footer>{r.choice(SMALL)}</footer></body></html>'
    return page, [title, *first, *steps, *last]


def old(r):
    blocks = _blocks(r, 2, 6)
    page = f'<HTML><BODY><CENTER class="banner">Welcome</CENTER><DIV class="menu">{" | ".join(f"<A HREF=#>{m}</A>" for m in MENU[:5])}</DIV>' + "".join(f"<P>{b}" for b in blocks) + f'<DIV class="footer">{r.choice(SMALL)}</DIV></BODY></HTML>'
    return page, blocks


def bare(r):
    blocks = _blocks(r, 1, 4)
    return "<html><body>" + "".join(f"<p>{b}</p>" for b in blocks) + "</body></html>", blocks


def one_block(r):
    block = _blocks(r, 1, 1)[0]
    return r.choice(["{}", "<p>{}</p>", "<div>{}</div>", "<html><body>{}</body></html>", "<html><body><div><div>{}</div></div></body></html>"]).format(block), [block]


def shop(r):
    title, blocks = r.choice(TITLES), _blocks(r, 2, 4)
    page = f'<html><body><div class="cookie-banner"><p>{SMALL[1]}</p><button>OK</button></div><header><nav>{_list(r, 5)}</nav><form class="search"><input><button>Go</button></form></header><div class="advert"><p>{SMALL[2]}</p></div><article class="story"><h1>{title}</h1>' + "".join(f"<p>{b}</p>" + (f'<div class="ad-slot">{SMALL[2]}</div>' if i == 1 else "") for i, b in enumerate(blocks)) + f'<div class="share"><a href="#">Share</a></div></article><div class="newsletter"><p>{SMALL[0]}</p></div><footer>{SMALL[3]}</footer></body></html>'
    return page, [title, *blocks]


KINDS = {f.__name__: f for f in (news, blog, manual, old, bare, one_block, shop)}


def pages(n: int, seed: int):
    """(kind, html, article text) of n pages, kinds in turn."""
    r = random.Random(seed)
    for i in range(n):
        kind = list(KINDS)[i % len(KINDS)]
        html, blocks = KINDS[kind](r)
        yield kind, html, "\n".join(blocks)
