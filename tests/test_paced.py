"""Paced model calls against a stub server, and passages against the index."""

from __future__ import annotations

import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from veristrata.operators import index_store, paced


@pytest.fixture
def server():
    log, lock = [], threading.Lock()

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            text = self.rfile.read(int(self.headers["Content-Length"])).decode()
            with lock:
                seen = sum(t == text for _, t in log)
                log.append((time.monotonic(), text))
            n = int(text[1:])
            status = 503 if n % 10 == 3 and seen < 2 else 429 if n % 10 == 4 and seen < 1 else 400 if n % 10 == 5 else 500 if n == 6 else 200
            time.sleep(0.01)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(f"r{n}".encode())

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/", log
    s.shutdown()


def test_rate_order_and_retries(spark, server):
    url, log = server
    pace = paced.Pace(per_second=40, tasks=4, in_flight=3, retries=3, backoff=0.01)
    items = spark.range(60).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"), "id")
    out = paced.stage(items, paced.http_client(url), pace)
    assert out.rdd.getNumPartitions() == 4
    log.clear()
    rows = {r.id: r for r in out.collect()}
    sent = Counter(t for _, t in log)
    for n, r in rows.items():
        want = (3, "ok") if n % 10 == 3 else (2, "ok") if n % 10 == 4 else (1, "failed") if n % 10 == 5 else (4, "failed") if n == 6 else (1, "ok")
        assert (r.attempts, r.execution_status) == want and sent[f"p{n}"] == want[0], n
        assert r.reply == (f"r{n}" if r.execution_status == "ok" else r.reply) and (r.execution_status == "ok" or r.reply.startswith("TransportError: HTTP"))
    times = sorted(t for t, _ in log)
    for i, t in enumerate(times):  # in any second, the rate and one request a task more at most
        assert sum(t <= u < t + 1 for u in times[i:]) <= 40 + 4 + 4


def test_errors_of_the_client_fail_rows(spark):
    def client():
        def ask(p):
            if p == "b":
                raise KeyError("x")
            return p.upper()

        return ask

    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    got = {r.prompt: (r.reply, r.execution_status, r.attempts) for r in paced.stage(df, client, paced.Pace(1000, tasks=2)).collect()}
    assert got == {"a": ("A", "ok", 1), "b": ("KeyError: 'x'", "failed", 1)}
    assert paced.stage(df.limit(0), client, paced.Pace(1000)).count() == 0
    with pytest.raises(ValueError):
        paced.Pace(0)


def test_passages_are_what_was_indexed(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}" if i else None) for i in range(200)], "doc_id long, text string")
    ix, out = str(tmp_path / "ix"), str(tmp_path / "bundles")
    index_store.ensure(docs, ix, buckets=64)
    rows = [("a", 1, 1, 2.0, "text 1"), ("a", 2, 2, 1.0, "text 2"), ("b", 3, 1, 1.0, "another"), ("c", 999, 1, 1.0, "x"), ("d", 4, 2, 1.0, "text 4"), ("e", 0, 1, 1.0, None)]
    p = spark.createDataFrame(rows, "claim_id string, doc_id long, rank int, score double, text string")
    c = index_store.checked(p, ix)
    assert {(r.claim_id, r.doc_id): r.error for r in c.collect() if r.error} == {("b", 3): "text is not what was indexed", ("c", 999): "document is not in the index"}
    read = index_store.text_hashes(spark, ix, [5, 9])
    assert {f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()} == {"5", "9"}  # other buckets are not opened
    wrong = index_store.write_bundles(p, out, ix)
    assert sorted((r.check, r.key) for r in wrong.collect()) == [("passage", "b"), ("passage", "c"), ("ranks", "d")]
    schema = "claim_id string, doc_id long, rank int, score double, text string"
    assert Counter(r.claim_id for r in index_store.read_bundles(spark, out, schema).collect()) == {"a": 2, "e": 1}
    assert [r.doc_id for r in index_store.read_bundles(spark, out, schema, ["a"]).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(index_store.CorpusChanged):
        index_store.checked(p, str(tmp_path / "none"))
