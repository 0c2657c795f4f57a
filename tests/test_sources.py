"""Archives in parts, trees listed in tasks, requests to a model under way at once."""

import io
import os
import random
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from siftline.operators import triage
from siftline.sources import model, repository


def packed(kind, files, folder):
    path = str(folder / f"a.{kind}")
    if kind == "zip":
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("d/", "")
            for name, data in files.items():
                z.writestr(name, data)
    else:
        with tarfile.open(path, "w:gz") as t:
            for name, data in files.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return path


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_archives_in_parts(spark, tmp_path, kind):
    repository.register(spark)
    rng = random.Random(15)
    files = {f"d/f{i}.bin": rng.randbytes(rng.randrange(3000)) for i in range(60)}
    path = packed(kind, files, tmp_path)
    for address in (path, f"file://{path}"):
        df = spark.read.format("siftline-archive").option("partBytes", 9000).load(address)
        assert {r.path: bytes(r.content) for r in df.collect()} == files and {r.archive for r in df.select("archive").distinct().collect()} == {address}
        assert df.rdd.getNumPartitions() == 1 if kind == "tar" else df.rdd.getNumPartitions() > 5
    assert dict(repository.members(open(path, "rb").read())) == files


def test_limits_of_archives(tmp_path, monkeypatch):
    monkeypatch.setattr(repository, "ARCHIVE_FILE_BYTES", 100)
    monkeypatch.setattr(repository, "ARCHIVE_BYTES", 250)
    monkeypatch.setattr(repository, "ARCHIVE_FILES", 4)
    for no, files in enumerate([{"a": b"x" * 101}, {f"f{i}": b"x" * 90 for i in range(3)}, {f"f{i}": b"" for i in range(5)}, {"../a": b""}, {"/a": b""}]):
        for kind in ("zip", "tar"):
            folder = tmp_path / f"{no}{kind}"
            folder.mkdir()
            path = packed(kind, files, folder)
            with pytest.raises(ValueError):
                list(repository.members(open(path, "rb")))
            if kind == "zip":
                with pytest.raises(ValueError):
                    repository.ArchiveReader([path], 1).partitions()
    data = bytearray(open(packed("zip", {"a": b"y" * 90}, tmp_path), "rb").read())
    at = data.rindex(b"PK\1\2") + 24
    data[at : at + 4] = (5).to_bytes(4, "little")  # the central directory says less than there is
    with pytest.raises((ValueError, zipfile.BadZipFile)):
        list(repository.members(bytes(data)))


def test_trees_listed_in_tasks(spark, tmp_path):
    repository.register(spark)
    rng = random.Random(16)
    root = tmp_path / "t"
    for _ in range(150):
        folder = root.joinpath(*(rng.choice(["a", "a-b", "a.c", "é", "node_modules", "z"]) for _ in range(rng.randrange(4))))
        folder.mkdir(parents=True, exist_ok=True)
        name = rng.choice(["x", "x.py", "B", "é", "0", "~"]) + str(rng.randrange(3))
        if not (folder / name).exists():
            (folder / name).write_bytes(rng.choice([b"text", b"\0bin", b"y" * 50, b""]))
    os.symlink(root, root / "a" / "loop")
    os.symlink(root / "gone", root / "a" / "dangling")
    for skipped in (False, True):
        for most in (10**6, 40, 1):
            want = spark.read.format("siftline-tree").options(maxFiles=most, maxBytes=40, skipped=str(skipped).lower()).load(str(root)).collect()
            got = repository.read_tree(spark, str(root), most, 40, skipped).collect()
            assert sorted(map(str, got)) == sorted(map(str, want)), (skipped, most)
    (tmp_path / "none").mkdir()
    assert repository.read_tree(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("budget", [(10**6, 10**6), (600, 10**6), (10**6, 150), (900, 240), None])
@pytest.mark.parametrize("reserve", [None, lambda prompt: (0, 0)])
def test_window_equals_a_serial_run(spark, budget, reserve):
    def slow(prompt):
        n = sum(map(ord, prompt))
        time.sleep(n * 7919 % 13 / 600)
        if n % 11 == 0:
            raise model.ModelError("refused")
        return f"{prompt}!" if n % 5 else "unusable", n % 23, n % 7

    rng = random.Random(17)
    rows = [(i, rng.choice([None, f"k{rng.randrange(20)}"]), "p" * rng.randrange(1, 60) + str(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "ord long, key string, prompt string").coalesce(1)
    run = lambda window: [tuple(r) for r in triage.ask(df, slow, 2, budget, accept=lambda text: text.endswith("!"), window=window, reserve=reserve).orderBy("ord").collect()]
    assert run(8) == run(1)


def test_window_is_faster(spark):
    def wait(prompt):
        time.sleep(0.05)
        return "ok", 1, 1

    df = spark.createDataFrame([(i, f"p{i}") for i in range(160)], "ord long, prompt string").coalesce(1)
    took = []
    for window in (1, 16):
        start = time.time()
        assert triage.ask(df, wait, accept=lambda text: True, window=window).where("status = 'answered'").count() == 160
        took.append(time.time() - start)
    assert took[0] > 8 and took[1] < took[0] / 2


def test_hosted_model():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["x-api-key"], body))
            code = 529 if len(seen) == 1 else 400 if body["messages"][0]["content"] == "bad" else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"content": [{"type": "text", "text": "a"}, {"type": "other"}, {"type": "text", "text": "b"}], "usage": {"input_tokens": 3, "output_tokens": 2}}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        ask = model.hosted_model("m", "secret", f"http://127.0.0.1:{server.server_port}")
        assert ask("hello") == model.ModelReply("ab", 3, 2)
        path, key, body = seen[-1]
        assert (path, key, body["model"], body["temperature"], body["max_tokens"], body["messages"]) == ("/v1/messages", "secret", "m", 0, 1024, [{"role": "user", "content": "hello"}]) and len(seen) == 2
        with pytest.raises(model.ModelError):
            ask("bad")
    finally:
        server.shutdown()
    with pytest.raises(model.ModelError):
        model.hosted_model("m", None)
    assert F is not None
