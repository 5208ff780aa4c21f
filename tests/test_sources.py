import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyfold.operators import fold, vector
from keyfold.schema import COMMAND, KV
from keyfold.sources import command_log, snapshot
from keyfold.streaming import replay
from tests.test_fold import random_log, simulated

words = st.lists(st.binary(max_size=12), min_size=1, max_size=5)


def framed(args):
    return b"*%d\r\n" % len(args) + b"".join(b"$%d\r\n%s\r\n" % (len(a), a) for a in args)


@given(st.lists(words, max_size=6), st.integers(0, 40))
def test_frames_round_trip_and_cut(commands, cut):
    data = b"".join(map(framed, commands))
    assert list(command_log.frames(data)) == commands
    short = list(command_log.frames(data[: max(0, len(data) - cut)]))
    assert short == commands[: len(short)] and (len(short) == len(commands) or cut)


def test_bad_frames_end_a_log():
    good = framed([b"GET", b"k"])
    for bad in (b"*0\r\n", b"*x\r\n", b"PING\r\n", b"*1\r\n$3\r\nGETxx"):
        assert list(command_log.frames(good + bad + good)) == [[b"GET", b"k"]]


def test_log_round_trip_with_line_ends(spark, tmp_path):
    rows = [(1, 0, "rbtree", "SET", "k\r\né", "a\nb", None), (2, 0, "hash", "SETEX", "x", "", 5000), (3, 0, "skiplist", "EXPIRE", "x", None, 7000), (4, 0, "array", "DEL", "x", None, None)]
    command_log.write_log(spark.createDataFrame(rows, COMMAND), str(tmp_path / "log"))
    read = command_log.read_frames(spark, str(tmp_path / "log"))
    assert [r.argv for r in read.orderBy("seq").collect()] == [["RSET", "k\r\né", "a\nb"], ["HSETEX", "x", "", "5"], ["SKEXPIRE", "x", "7"], ["DEL", "x"]]
    back = command_log.commands_of(read, F.lit(0).cast("long")).orderBy("seq")
    assert [tuple(r) for r in back.collect()] == rows


def test_snapshot_round_trips(spark, tmp_path):
    kv = spark.createDataFrame([("array", "a", "1", None), ("hash", "é", "", 5), ("skiplist", "s", "x", -7)], KV)
    vectors = vector.stored(spark.createDataFrame([("q", "a", [0.5, -1.25])], "question string, answer string, vector array<float>"))
    snapshot.write_table(kv, str(tmp_path / "table"))
    assert {tuple(r) for r in snapshot.read_table(spark, str(tmp_path / "table")).collect()} == {tuple(r) for r in kv.collect()}
    for _ in range(2):  # a second write replaces the first
        snapshot.write_binary(snapshot.records(kv, vectors), str(tmp_path / "records"))
    rows = snapshot.read_binary(spark, str(tmp_path / "records"))
    assert {tuple(r) for r in snapshot.keyspaces(rows).collect()} == {tuple(r) for r in kv.collect()}
    assert [tuple(r) for r in snapshot.vectors(rows).collect()] == [("q", "a", [0.5, -1.25])]


def test_truncated_snapshot_ends_quietly():
    data = snapshot.encode((1, None, "k", "v", None, None)) + snapshot.encode((3, 9, "key", "value", None, None))
    for cut in range(len(data)):
        assert list(snapshot.decode(data[:cut])) == [(1, None, "k", "v", None, None)][: int(cut >= 19)]


def test_follower(spark, tmp_path):
    rows = random_log(11, "array", 600, 30)
    log = spark.createDataFrame(rows, COMMAND)
    follower = replay.Follower(spark, str(tmp_path / "follower"))
    cut = 300
    start = fold.folded(log.filter(F.col("seq") <= cut)).groupBy("engine", "key").agg(F.max_by(F.struct("present_after", "val", "exp"), "seq").alias("s"))
    start = start.filter("s.present_after").select("engine", "key", F.col("s.val").alias("value"), F.col("s.exp").alias("expire_ms"))
    follower.load(start, cut)
    for low, high in ((200, 450), (400, 600), (400, 600)):  # batches overlap and repeat
        follower.apply_batch(log.filter((F.col("seq") > low) & (F.col("seq") <= high)))
    now = rows[-1][1]
    _, space = simulated(rows, "array")
    assert {r.key: (r.value, r.expire_ms) for r in replay.current(follower.table(), now).collect()} == space.live(now)
    assert follower.refuses("SET") == "READONLY" and follower.refuses("GET") is None


def test_stream_equals_batch(spark, tmp_path):
    rows = random_log(13, "hash", 400, 20)
    log = spark.createDataFrame(rows, COMMAND)
    log.filter("seq < 200").coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # two runs with the same checkpoint: the state is kept between them
        stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
        replies = replay.replay_stream(stream)
        replies.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        log.filter("seq >= 150").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # repeats of 150..199 are dropped
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    replay.replay_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    expected, _ = simulated(rows, "hash")
    got = [(r.seq, r.reply) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=lambda x: x[0]) == sorted(expected.items())


def test_gaps(spark):
    rows = spark.createDataFrame([("f", 1), ("f", 2), ("f", 5), ("g", 9)], "flow string, seq long")
    assert [tuple(r) for r in replay.gaps(rows, "flow").collect()] == [("f", 2, 5, 2)]


def test_log_keeps_every_command(spark, tmp_path):
    """Times to live are never shortened, a command without a key is refused, and bytes that cannot be read are told."""
    rows = [(1, 0, "array", "SETEX", "k", "v", 500), (2, 0, "array", "SETEX", "k", "é\r\n$3\r\nx", 1001), (3, 0, "array", "EXPIRE", "k", None, -1500), (4, 0, "array", "SET", "", None, None)]
    command_log.write_log(spark.createDataFrame(rows, COMMAND), str(tmp_path / "log"))
    back = command_log.commands_of(command_log.read_frames(spark, str(tmp_path / "log")), F.lit(0).cast("long")).orderBy("seq").collect()
    assert [(r.key, r.value, r.ttl_ms) for r in back] == [("k", "v", 1000), ("k", "é\r\n$3\r\nx", 2000), ("k", None, -1000), ("", "", None)]
    assert sum(r.unread for r in command_log.unread(spark, str(tmp_path / "log")).collect()) == 0
    with pytest.raises(Exception, match="without a key"):
        command_log.write_log(spark.createDataFrame([(1, 0, "array", "GET", None, None, None), *rows], COMMAND), str(tmp_path / "bad"))
    whole = framed([b"SET", b"a", b"b"])
    (tmp_path / "cut").write_bytes(whole * 3 + whole[:-3])
    assert [(r.size, r.unread) for r in command_log.unread(spark, str(tmp_path / "cut")).collect()] == [(len(whole) * 4 - 3, len(whole) - 3)]


def test_one_log_in_any_number_of_segments(spark, tmp_path):
    commands = [framed([b"SET", b"k%d" % (i % 7), b"v\r\n" * (i % 3)]) for i in range(200)]
    for name, cuts in (("many", (0, 60, 61, 200)), ("one", (0, 200))):
        (tmp_path / name).mkdir()
        for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
            (tmp_path / name / f"segment-{i}").write_bytes(b"".join(commands[low:high]))
    many, one = (sorted((r.seq, r.argv) for r in command_log.read_frames(spark, str(tmp_path / n)).collect()) for n in ("many", "one"))
    assert many == one and [s for s, _ in one] == list(range(1, 201)) and one[2][1] == ["SET", "k2", "v\r\nv\r\n"]


def test_arguments_of_a_column(spark):
    texts = [framed([b"SET", "é\r\n".encode(), b""]).decode(), "*1\r\n$9\r\nx\r\n", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, frame string")
    assert {r.i: r.argv for r in command_log.arguments(rows).collect()} == {0: ["SET", "é\r\n", ""], 1: None, 2: None, 3: None}


def test_single_snapshot_file(spark, tmp_path):
    """Bytes laid out by hand: type, expiry, key, value; and a vector with its text."""
    text = b"0.500000,-1.250000"
    data = b"\x03" + struct.pack("<q", 9) + struct.pack("<i", 1) + b"k" + struct.pack("<i", 2) + b"vv"
    data += b"\x05" + struct.pack("<i", 1) + b"q" + struct.pack("<i", 1) + b"a" + struct.pack("<i", 2) + struct.pack("<i", len(text)) + text
    (tmp_path / "kv.rdb").write_bytes(data)
    rows = snapshot.read_binary(spark, str(tmp_path / "kv.rdb"))
    assert [tuple(r) for r in snapshot.keyspaces(rows).collect()] == [("hash", "k", "vv", 9)]
    assert [tuple(r) for r in snapshot.vectors(rows).collect()] == [("q", "a", [0.5, -1.25])]


def test_follower_goes_on_after_a_restart(spark, tmp_path):
    rows = random_log(17, "hash", 300, 20)
    log, path = spark.createDataFrame(rows, COMMAND), str(tmp_path / "follower")
    replay.Follower(spark, path).load(spark.createDataFrame([], KV), -1)
    for low, high in ((-1, 120), (100, 200), (180, 300), (-1, 300)):
        follower = replay.Follower(spark, path)  # nothing but the folder tells where to go on
        follower.apply_batch(log.filter((F.col("seq") > low) & (F.col("seq") <= high)))
    _, space = simulated(rows, "hash")
    now = rows[-1][1]
    again = replay.Follower(spark, path)
    assert again.seq == 299 and {r.key: (r.value, r.expire_ms) for r in replay.current(again.table(), now).collect()} == space.live(now)
    assert sorted(p.name for p in (tmp_path / "follower").iterdir()) == ["held", "v3", "v4"]
