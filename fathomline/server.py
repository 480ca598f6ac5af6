"""A thin HTTP shell around the request handlers, and a client for it."""

from __future__ import annotations

import json
import shutil
import ssl
import tempfile
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from fathomline.operators.results import Records, write_answer
from fathomline.schema import QuerySet


def made(records: Records, host: str = "127.0.0.1", port: int = 8888, paged: bool = False, certificate: str | None = None, private_key: str | None = None) -> ThreadingHTTPServer:
    """A server that answers a JSON request at any path, from one table or from a lookup for each key.

    GET requests and empty bodies are bad requests when paged. With a certificate it speaks TLS.
    """

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            with tempfile.TemporaryFile() as out:  # an answer may be larger than memory
                if paged and (self.command != "POST" or not body):
                    status = 400
                    out.write(json.dumps({"error": "send a POST request with a body"}).encode())
                else:
                    status = write_answer(records, body, out, paged)
                self.send_response(status)
                self.send_header("Content-Type", "application/json" if status == 200 or paged else "text/plain")
                self.send_header("Content-Length", str(out.tell()))
                self.end_headers()
                out.seek(0)
                shutil.copyfileobj(out, self.wfile)

        do_GET = do_POST = do_PUT = _do

        def log_message(self, *args) -> None:  # requests name people: nothing is logged
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    if certificate:
        context = ssl.SSLContext(ssl.PROTOCOL_TLS_SERVER)
        context.load_cert_chain(certificate, private_key)
        server.socket = context.wrap_socket(server.socket, server_side=True)
    return server


def serve(records: Records, host: str, port: int, paged: bool = False, certificate: str | None = None, private_key: str | None = None) -> None:
    made(records, host, port, paged, certificate, private_key).serve_forever()


class Client:
    """Asks a server; an answer other than 200 is an error."""

    def __init__(self, url: str, token: str = "", timeout: float = 30, verify: bool = True, proxy: str | None = None):
        self.url, self.token, self.timeout = url, token, timeout
        context = ssl.create_default_context()
        if not verify:
            context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
        handlers: list = [urllib.request.HTTPSHandler(context=context)]
        if proxy:
            handlers.append(urllib.request.ProxyHandler({"http": proxy, "https": proxy}))
        self.opener = urllib.request.build_opener(*handlers)

    def query(self, query: QuerySet) -> dict:
        body = json.dumps({"email": query.email, "domain": query.domain, "user": query.user, "page": query.page}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "x-api-key": self.token}, method="POST")
        try:
            with self.opener.open(request, timeout=self.timeout) as found:
                return json.load(found)
        except urllib.error.HTTPError as e:
            raise ValueError(f"status {e.code}: {e.read().decode(errors='replace')}") from e
