"""A log that grows, runs that are killed, tails."""

import json
import random

import pytest

from quillgraph.streaming import event_log as E


def run(spark, log, root, cursor=None, fail_at=None, size=40):
    seen = []

    def sink(batch, k):
        if k == fail_at:
            raise RuntimeError("killed")
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={k}")
        seen.append(k)

    stream = E.event_stream(spark, str(log), cursor, size)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    return seen


def events(spark, root):
    return sorted((r.file, r.offset, r.event or r.raw) for r in spark.read.schema(E.SCHEMA).parquet(f"{root}/out").collect())


def lines(log):
    out = []
    for f in sorted(log.iterdir()):
        at = 0
        for line in f.read_bytes().split(b"\n")[:-1]:
            if line.strip():
                out.append((f.name, at, line.decode()))
            at += len(line) + 1
    return sorted(out)


def test_killed_and_resumed_runs_give_each_event_once(spark, tmp_path):
    r, log = random.Random(2), tmp_path / "log"
    log.mkdir()
    half = {}
    for step in range(5):
        for name in ("a.jsonl", "b.jsonl", "late.jsonl")[: 2 + (step > 1)]:
            text = half.pop(name, "") + "".join(json.dumps({"n": step, "é": "x" * r.randint(0, 60)}, ensure_ascii=False) + "\n" for _ in range(r.randint(0, 6))) + r.choice(["", "\n", "not json {\n"])
            whole = json.dumps({"cut": step}) + "\n"
            half[name] = whole[7:]
            with open(log / name, "a") as f:
                f.write(text + whole[:7])
        if step in (1, 3):
            with pytest.raises(Exception, match="killed"):
                run(spark, log, tmp_path, fail_at=step)
        run(spark, log, tmp_path)
        assert events(spark, tmp_path) == lines(log)
    assert any(e.raw for e in spark.read.schema(E.SCHEMA).parquet(f"{tmp_path}/out").collect())


def test_tail(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(20_000)) + '{"n": ')
    (log / "b.jsonl").write_text('{"n": 1}\n')
    (log / "empty.jsonl").write_text("")
    cursor = E.tail_cursor(str(log), 3)
    run(spark, log, tmp_path, cursor, size=10)
    assert events(spark, tmp_path) == [x for x in lines(log) if x[0] == "b.jsonl" or json.loads(x[2])["n"] >= 19_997]
    assert json.loads(E.tail_cursor(str(log), 10**6)) == {"a.jsonl": 0, "b.jsonl": 0, "empty.jsonl": 0}


def test_a_file_that_got_shorter(tmp_path):
    (tmp_path / "a").write_text("{}\n{}\n")
    reader = E._Reader({"path": str(tmp_path)})
    assert reader.latestOffset() == {"a": 6}
    (tmp_path / "a").write_text("{}\n")
    with pytest.raises(ValueError, match="have been read"):
        reader.latestOffset()
