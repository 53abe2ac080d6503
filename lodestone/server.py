"""A thin HTTP front of an engine, on the standard library: the routes and status texts of the service."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from lodestone.engine import Engine
from lodestone.errors import EngineError, ParseError
from lodestone.page import page

PORT = 3333


def answer(engine: Engine, method: str, target: str, body: str = "") -> tuple[int, str]:
    """Status and JSON (or error) text for a request; any error of the engine is a 400."""
    url = urlsplit(target)
    parts = [unquote(p) for p in url.path.strip("/").split("/")]
    query = parse_qs(url.query, keep_blank_values=True)
    try:
        match (method, parts):
            case ("PUT", ["indexes", name]):
                return 200, json.dumps(engine.create_index(name, body))
            case ("PATCH", ["indexes", name, "mapping"]):
                return 200, json.dumps(engine.update_mapping(name, json.loads(body)))
            case ("POST", ["indexes", name, "documents"]):
                engine.index_docs(name, body)
                return 200, json.dumps({"status": "indexed"})
            case ("GET", ["indexes", name, "search"]):
                fuzzy = query.get("fuzzy", ["false"])[0].lower() == "true"
                return 200, engine.search_json(name, query.get("q", [""])[0], fuzzy)
            case ("GET", ["indexes", name, "_layout"]):
                tables = {k: [r.asDict(True) for r in v.collect()] for k, v in engine.layout(name).items()}
                return 200, json.dumps(tables) if query.get("format") == ["json"] else page(name, tables)
            case ("POST", ["flush-state"]):
                engine.flush()
                return 200, json.dumps({"status": "flushed"})
        return 404, "not found"
    except json.JSONDecodeError as e:
        return 400, f"ParseError: {e}"
    except (EngineError, ParseError) as e:
        return 400, f"{type(e).__name__}: {e}"


def serve(engine: Engine, port: int = PORT) -> ThreadingHTTPServer:
    """A server for ``engine``; call ``serve_forever`` on it."""

    class Handler(BaseHTTPRequestHandler):
        def respond(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8")
            status, text = answer(engine, self.command, self.path, body)
            data = text.encode("utf-8")
            self.send_response(status)
            kind = "text/plain" if status != 200 else "text/html" if text.startswith("<!doctype") else "application/json"
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_PUT = do_PATCH = do_POST = respond

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
