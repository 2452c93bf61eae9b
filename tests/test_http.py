"""Fetching: a local server that answers well, badly and not at all."""

import http.server
import socket
import threading
import time

import pytest

from veldspar.plans import service
from veldspar.sources import http as web


class Handler(http.server.BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    seen: dict = {}
    open_now = most_open = 0
    lock = threading.Lock()

    def raw(self, data):
        self.wfile.write(data)
        self.close_connection = True

    def do_GET(self):
        path = self.path.split("?")[0]
        with self.lock:
            n = self.seen[path] = self.seen.get(path, 0) + 1
        if path.startswith("/slowly"):
            with self.lock:
                Handler.open_now += 1
                Handler.most_open = max(Handler.most_open, Handler.open_now)
            time.sleep(0.05)
            with self.lock:
                Handler.open_now -= 1
        if path == "/garbage.eml":
            self.raw(b"nonsense\r\n\r\n")
        elif path == "/short.eml":
            self.raw(b"HTTP/1.1 200 OK\r\nContent-Length: 100\r\n\r\nabc")
        elif path == "/shortonce.eml" and n == 1:
            self.raw(b"HTTP/1.1 200 OK\r\nContent-Length: 100\r\n\r\nabc")
        elif path == "/badchunk.eml":
            self.raw(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabc")
        elif path == "/chunked.eml":
            self.raw(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n")
        elif path == "/silent.eml":
            time.sleep(3)
            self.close_connection = True
        elif path == "/drip.eml":
            self.wfile.write(b"HTTP/1.1 200 OK\r\nContent-Length: 1000\r\n\r\n")
            for _ in range(40):
                try:
                    self.wfile.write(b"x")
                    self.wfile.flush()
                except OSError:
                    break
                time.sleep(0.1)
            self.close_connection = True
        elif path == "/busy.eml" and n < 3:
            self.raw(b"HTTP/1.1 503 Busy\r\nContent-Length: 0\r\n\r\n")
        elif path == "/gone.eml":
            self.raw(b"HTTP/1.1 404 No\r\nContent-Length: 0\r\n\r\n")
        elif path == "/reset.eml":
            self.connection.shutdown(socket.SHUT_RDWR)
            self.close_connection = True
        else:
            body = b"x" * 5000 if path == "/large.eml" else b"Content-Type: text/plain\n\nHello there."
            self.raw(b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def top():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


CASES = {
    "/a.eml": ("ok", None, 1), "/garbage.eml": ("not_found", "protocol", 3), "/short.eml": ("not_found", "truncated", 3), "/shortonce.eml": ("ok", None, 2), "/badchunk.eml": ("not_found", "truncated", 3),
    "/chunked.eml": ("ok", None, 1), "/silent.eml": ("not_found", "timeout", 1), "/drip.eml": ("not_found", "timeout", 1), "/busy.eml": ("ok", None, 3), "/gone.eml": ("not_found", "status_404", 1),
    "/reset.eml": ("not_found", None, 3), "/large.eml": ("too_large", "too_large", 1), "/a b.eml": ("not_found", "bad_url", 1), "/\x00.eml": ("not_found", "bad_url", 1), "/é.eml": ("not_found", "bad_url", 1),
}
OTHERS = {None: "bad_url", "": "bad_url", "file:///etc/hosts.eml": "bad_url", "http://[bad/x.eml": "bad_url", "http://": None, "http://127.0.0.1:1/x.eml": "connection", "http://host:port/x": "bad_url", "http://no.such.host.invalid/x.eml": None}


def test_every_url_is_one_row(spark, top):
    Handler.seen.clear()
    urls = [top + p for p in CASES] + list(OTHERS)
    rows = spark.createDataFrame([(str(k), u) for k, u in enumerate(urls)], "request_id string, document_url string")
    got = {r.request_id: r for r in web.fetched(rows, timeout=1.0, pause=0.01, most=4000, lanes=3).collect()}
    assert len(got) == len(urls)
    for k, (path, (status, reason, attempts)) in enumerate(CASES.items()):
        r = got[str(k)]
        assert (r.fetch_status, r.attempts) == (status, attempts), path
        assert r.reason == reason or path == "/reset.eml", path
        assert (r.content is not None) == (status == "ok") and r.seconds < 3
    for k, (url, reason) in enumerate(OTHERS.items(), len(CASES)):
        r = got[str(k)]
        assert (r.document_url, r.fetch_status, r.content) == (url, "not_found", None) and (reason is None or r.reason == reason), url
    assert got["5"].content == b"abcde" and got["0"].content.endswith(b"Hello there.")


def test_rejects_and_download(spark, top):
    rows = spark.createDataFrame([("1", f"{top}/fine.eml?x"), ("2", f"{top}/short.eml"), ("3", f"{top}/a b.eml"), ("1", f"{top}/fine.eml?x")], "request_id string, document_url string")
    found = web.fetched(rows, pause=0.01)
    assert sorted((r.request_id, r.reason) for r in web.rejects(found).collect()) == [("2", "truncated"), ("3", "bad_url")]
    told = service.download(rows)
    assert sorted((r.source_file.rpartition("/")[2], r.status, r.text) for r in told.collect()) == [("a b.eml", "not_found", None), ("fine.eml?x", "ok", "Hello there."), ("fine.eml?x", "ok", "Hello there."), ("short.eml", "not_found", None)]
    assert web.fetched(rows.limit(0)).collect() == []


def test_a_host_has_few_connections(spark, top):
    Handler.most_open = 0
    rows = spark.createDataFrame([(str(k), f"{top}/slowly{k}.eml") for k in range(40)], "request_id string, document_url string")
    for lanes, per_host in ((4, 1), (4, 2)):
        Handler.most_open = 0
        assert web.fetched(rows, lanes=lanes, per_host=per_host).where("fetch_status = 'ok'").count() == 40
        assert Handler.most_open <= per_host


def test_hosts_by_the_clock():
    now, slept = [0.0], []
    hosts = web.Hosts(2.0, 2, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    ok, lost = web.Fetched(b"", "ok", None, 1, 0.0), web.Fetched(None, "not_found", "connection", 1, 0.0)
    assert [hosts.get(h, lambda: ok).status for h in ("a", "b", "a")] == ["ok"] * 3 and slept == [2.0]
    asked = []
    for _ in range(4):
        hosts.get("c", lambda: (asked.append(1), lost)[1])
    assert len(asked) == 2 and hosts.get("c", lambda: ok).reason == "host_down" and hosts.get("a", lambda: ok).status == "ok"
    assert [web.host_of(u) for u in ("HTTP://U:p@Host.X:80/a", None, "http://[bad", "plain")] == ["host.x:80", "", "", ""]
