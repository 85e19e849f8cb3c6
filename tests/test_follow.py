"""Following files by proof: edits anywhere, appends, rewrites, unfinished lines, charsets; against a model that rereads everything."""

import os
import random

from tidelog.streaming import follow, tail


def whole_lines(data):
    charset, mark, _ = tail.charset_of(data[:3])
    return data[mark:].decode(charset, "replace").split("\n")[:-1]


class Model:
    def __init__(self):
        self.have = {}

    def look(self, folder):
        """(name, generation, line_no, raw) that are new."""
        out = []
        for name in sorted(os.listdir(folder)):
            data = (folder / name).read_bytes()
            if not data or not name.lower().endswith((".log", ".out")):
                continue
            old = self.have.get(name)
            generation, known = (0, 0) if old is None else (old[0], len(whole_lines(old[1]))) if data.startswith(old[1]) else (old[0] + 1, 0)
            self.have[name] = (generation, data)
            out += [(name, generation, n, t) for n, t in enumerate(whole_lines(data)) if n >= known]
        return sorted(out)


def found(chunks):
    return sorted((r["path"].rsplit("/", 1)[1], r["generation"], r["line_no"], r["raw"]) for r in tail.lines_of(chunks).collect())


def touch(path, data, step):
    path.write_bytes(data)
    os.utime(path, (1_700_000_000 + step, 1_700_000_000 + step))


def test_steps_agree_with_a_model(spark, tmp_path):
    rng, model, logs = random.Random(6), Model(), tmp_path / "logs"
    logs.mkdir()
    piece = lambda: "".join(rng.choice(["\n", "a", "é", "😀", "line\n", "x" * 9]) for _ in range(rng.randrange(0, 14)))
    kinds = {"a.log": ("utf-8", b""), "b.OUT": ("utf-8", b"\xef\xbb\xbf"), "c.log": ("utf-16-le", b"\xff\xfe"), "d.log": ("utf-16-be", b"\xfe\xff"), "z.txt": ("utf-8", b"")}
    for step in range(5):
        for name, (charset, mark) in kinds.items():
            path = logs / name
            had = path.read_bytes() if path.exists() else mark
            what = rng.choice(["append", "append", "nothing", "edit", "rewrite"]) if step else "append"
            if what == "nothing":
                continue
            more = had + piece().encode(charset)
            if what == "edit" and len(had) > 12:  # one unit early on, then growth
                at = 8 + 2 * rng.randrange((len(had) - 8) // 2)
                more = more[:at] + "q".encode(charset).ljust(2, b"q")[:2] + more[at + 2 :]
            elif what == "rewrite":
                more = mark + piece().encode(charset)
            touch(path, more or b"\n", step)
        got = found(follow.advance(spark, str(tmp_path / "store"), str(logs), block_bytes=16))
        assert got == model.look(logs), step


def test_an_edit_far_behind_with_growth_is_a_rewrite(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    body = b"".join(b"line %d\n" % k for k in range(3000))
    touch(logs / "a.log", body, 0)
    store = str(tmp_path / "store")
    assert len(found(follow.advance(spark, store, str(logs), block_bytes=4096))) == 3000
    edited = body[:10_000] + b"#" + body[10_001:] + b"more\n"
    touch(logs / "a.log", edited, 1)
    got = found(follow.advance(spark, store, str(logs), block_bytes=4096))
    assert {g for _, g, _, _ in got} == {1} and len(got) == 3001
    # the same step once more, as after a failure; then growth alone, and a file emptied of its lines
    assert found(follow.advance(spark, store, str(logs), version=1, block_bytes=4096)) == got
    touch(logs / "a.log", edited + b"end\n", 2)
    assert found(follow.advance(spark, store, str(logs), block_bytes=4096)) == [("a.log", 1, 3001, "end")]
    touch(logs / "a.log", b"no newline", 3)
    chunks = follow.advance(spark, store, str(logs), block_bytes=4096)
    assert found(chunks) == [] and [(r["generation"], r["from_byte"], r["to_byte"]) for r in chunks.collect()] == [(2, 0, 0)]
    assert follow.advance(spark, store, str(logs), block_bytes=4096).collect() == []
