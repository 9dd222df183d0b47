import datetime
import json
import os
import random

from pyspark.sql import functions as F

from lurewatch.operators import reports, threats
from lurewatch.sources import feeds
from lurewatch.sources.keyed import KeyedTable
from lurewatch.streaming import jobs

NOON = datetime.datetime(2025, 12, 1, 12)
def as_of():
    return F.timestamp_seconds(F.lit(1764547200))


def at(seconds):
    return NOON + datetime.timedelta(seconds=seconds)


# -- the keyed table ------------------------------------------------------------------------------------


def keyed(spark, path):
    schema = spark.createDataFrame([], "k string, v int").schema
    return KeyedTable(spark, str(path), "k", schema, digits=1)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v int")


def listed(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_only_folders_that_may_hold_a_key_are_read(spark, tmp_path):
    table = keyed(spark, tmp_path)
    assert listed(table.read()) == [] and listed(table.lookup(rows(spark, ("a1", 0)))) == []
    table.append(rows(spark, ("a1", 1), ("b1", 2), ("b1", 2), (None, 3)), 0)
    table.append(rows(spark, ("a1", 4), ("c1", 5)), 1)
    asked = rows(spark, ("a1", 0), ("b1", 0), ("b2", 0), ("d9", 0), (None, 0))
    folders = {(r["_folder"], r["_prefix"]) for r in table.candidates(asked).collect()}
    assert folders == {("batch-0", "a"), ("batch-0", "b"), ("batch-1", "a")}
    assert listed(table.lookup(asked)) == [("a1", 1), ("a1", 4), ("b1", 2), ("b1", 2)]
    assert listed(table.lookup(asked, before=1)) == [("a1", 1), ("b1", 2), ("b1", 2)]
    found = table.lookup(rows(spark, ("b1", 0)))
    assert {f.split("_prefix=")[1][0] for f in found.inputFiles() if "_prefix" in f} == {"b"}


def test_filters_hold_every_key(spark, tmp_path):
    table = keyed(spark, tmp_path)
    keys = spark.range(20000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.lit(1).alias("v"))
    table.append(keys.where("substring(k, 64, 1) < '8'"), 0)
    found = {r["k"] for r in table.candidates(keys).collect()}
    there = {r["k"] for r in table.read().collect()}
    assert there <= found and len(found) - len(there) < 30


def test_compaction_and_unfinished_work(spark, tmp_path):
    table = keyed(spark, tmp_path)
    for batch in range(4):
        table.append(rows(spark, ("a1", batch), ("b1", batch)), batch)
    table.compact(2, F.col("v") > 0)
    assert table.live() == ["base-2", "batch-3"] and table.live(before=2) == ["batch-0", "batch-1"]
    assert listed(table.read()) == [("a1", 1), ("a1", 2), ("a1", 3), ("b1", 1), ("b1", 2), ("b1", 3)]
    table.append(rows(spark, ("a1", 30)), 3)  # the batch runs again
    assert listed(table.lookup(rows(spark, ("a1", 0)))) == [("a1", 1), ("a1", 2), ("a1", 30)]
    table.compact(3)
    os.remove(tmp_path / "filter-base-3" / "_SUCCESS")  # broken off before it was whole
    assert table.live() == ["base-2", "batch-3"]
    assert table.drop_superseded() == ["batch-0", "batch-1", "batch-2"] and not (tmp_path / "batch-1").exists()
    assert listed(table.lookup(rows(spark, ("a1", 0)))) == [("a1", 1), ("a1", 2), ("a1", 30)]


# -- feeds in order of arrival --------------------------------------------------------------------------


def test_first_landed_row_stays_whatever_the_partitions(spark, tmp_path):
    folder = tmp_path / "haus"
    folder.mkdir()
    store, checkpoint = str(tmp_path / "threats"), str(tmp_path / "check")

    def land(name, lines, when):
        (folder / name).write_text("".join(f"{i},d,{u}\n" for i, u in lines))
        os.utime(folder / name, (when, when))

    def run():
        stream = feeds.read_raw(spark, "urlhaus", str(folder), stream=True)
        return jobs.ingest(stream, as_of(), store, checkpoint, digits=1, compact_every=1)

    filler = [(f"f{i}", f"http://f/{i}") for i in range(300)]
    land("z.csv", [("1", "http://a"), *filler, ("2", "http://a")], 1000)
    land("a.csv", [("3", "http://a"), ("4", "http://b"), ("5", "http://b")], 2000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        run()
        land("b.csv", [("6", "http://b"), ("7", "http://c"), ("8", "http://a")], 3000)
        run()
        land("c.csv", [("9", "http://c"), ("10", "http://d")], 4000)
        table = run()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = {r["url"]: r["external_id"] for r in table.read().collect()}
    assert {u: found[u] for u in ("http://a", "http://b", "http://c", "http://d")} == {
        "http://a": "1", "http://b": "4", "http://c": "7", "http://d": "10"}
    assert len(found) == 304 and table.read().count() == 304
    assert any(name.startswith("base-") for name in table.live())
    known = table.lookup(threats.with_hash(spark.createDataFrame([("http://c",)], "url string")))
    assert [r["external_id"] for r in known.collect()] == ["7"]


def test_other_order_of_landing_keeps_the_other_row(spark, tmp_path):
    for first, second in (("x", "y"), ("y", "x")):
        folder = tmp_path / first
        folder.mkdir()
        for n, name in enumerate((first, second)):
            (folder / f"{name}.csv").write_text(f"{name},d,http://same\n")
            os.utime(folder / f"{name}.csv", (1000 + n, 1000 + n))
        stream = feeds.read_raw(spark, "urlhaus", str(folder), stream=True)
        table = jobs.ingest(stream, as_of(), digits=1)
        assert [r["external_id"] for r in table.read().collect()] == [first]


def test_records_of_several_lines_over_blocks(spark, tmp_path):
    """Against a reader that takes one character after the other."""

    def plain(text):
        found, lines, record = [], [line.removesuffix("\r") for line in text.split("\n")], None
        for line in lines:
            if record is None:
                if line == "" or line.startswith("#"):
                    continue
                record, field, quoted = [], "", False
                at = 0
            else:
                field, at = field + "\n", 0
            while True:
                if quoted:
                    end = line.find('"', at)
                    if end < 0:
                        field += line[at:]
                        break
                    field += line[at:end]
                    at = end + 1
                    if line[at:at + 1] == '"':
                        field, at = field + '"', at + 1
                        continue
                    quoted = False
                    if at == len(line):
                        found.append([*record, field])
                        record = None
                        break
                    if line[at] != ",":
                        record = None
                        break
                    record.append(field)
                    field, at = "", at + 1
                elif line[at:at + 1] == '"':
                    quoted, at = True, at + 1
                else:
                    end = line.find(",", at)
                    part = line[at:] if end < 0 else line[at:end]
                    if '"' in part:
                        record = None
                        break
                    if end < 0:
                        found.append([*record, part])
                        record = None
                        break
                    record.append(part)
                    at = end + 1
        return sorted((r[2], r[0]) for r in found if len(r) >= 3)

    rng = random.Random(6)
    bits = ['"', '"', '""', ",", ",", ",", "\n", "\n", "a", "b,c", "#", "\r\n", '"x","y","z"\n', '"q\nr",s,"t\n"\n']
    for number in range(3):
        text = "".join(rng.choice(bits) for _ in range(4000))
        (tmp_path / f"{number}.csv").write_bytes(text.encode())
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        try:
            found = feeds.read_feed(spark, "urlhaus", str(tmp_path / f"{number}.csv"))
            assert sorted((r["url"], r["external_id"]) for r in found.collect()) == plain(text)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_large_arrays_in_blocks(spark, tmp_path):
    """Nested objects, braces and quotes in texts; elements before a break only."""
    rng = random.Random(7)

    def element(i):
        inside = {"phish_id": i, "url": rng.choice(["http://x/", 'a"b}', "{[", "\\\\", "é}\n", ""]) + str(i)}
        inside |= rng.choice([{}, {"details": [{"ip": "1", "deep": {"deeper": [{"url": "no"}]}}]}, {"note": '}],[{"phish_id": 1}'}])
        return rng.choice([inside, inside, inside, 5, "text{", [{"phish_id": 3, "url": "in a list"}], None, {"phish_id": "x", "url": "text id"}])

    items = [element(i) for i in range(400)]
    wanted = [(x["url"], str(x["phish_id"])) for x in items if isinstance(x, dict) and isinstance(x["phish_id"], int)]
    for name, text, count in (
            ("whole", json.dumps(items, indent=1), None), ("compact", json.dumps(items, ensure_ascii=False, separators=(",", ":")), None),
            ("broken", json.dumps(items[:200]) [:-1] + ', {"phish_id": 7, "url": oops}, ' + json.dumps(items[200:])[1:], 200),
            ("cut", json.dumps(items[:100])[:-1] + ', {"phish_id": 1, "url": "half"', 100), ("object", '{"phish_id": 1, "url": "u"}', 0), ("empty", "[]", 0)):
        (tmp_path / f"{name}.json").write_bytes(text.encode())
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        try:
            found = feeds.read_feed(spark, "phishtank", str(tmp_path / f"{name}.json"))
            rows = sorted((r["url"], r["external_id"]) for r in found.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        read = items if count is None else items[:count]
        assert rows == sorted((x["url"], str(x["phish_id"])) for x in read if isinstance(x, dict) and isinstance(x["phish_id"], int)), name
        one = feeds.phishtank(spark.createDataFrame([(text,)], "value string"))
        assert sorted((r["url"], r["external_id"]) for r in one.collect()) == rows, name
    assert wanted


# -- windows by event time ------------------------------------------------------------------------------


def anchored(events, seconds):
    """Windows of the rows one after the other, in the order of time and id."""
    out, last = {}, {}
    for i, k, ts in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        if k not in last or (ts - last[k]).total_seconds() >= seconds:
            last[k] = ts
        out[i] = last[k]
    return out


def test_rows_out_of_order_wait_and_late_rows_are_listed(spark, tmp_path):
    rng = random.Random(3)
    events = [(i, rng.choice("aab"), at(rng.randrange(3000))) for i in range(200)]
    events.sort(key=lambda e: e[2] + datetime.timedelta(seconds=(e[0] % 3) * 50))  # up to 100 s late
    late = [(900, "a", at(-5000)), (901, "b", at(100))]
    folder, table, checkpoint = (str(tmp_path / n) for n in ("in", "windows", "check"))
    schema = "event_id int, k string, ts timestamp"
    for number, part in enumerate((events[:80], events[80:140] + late, events[140:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        for _ in range(2):  # a run without new files changes nothing
            jobs.run_windows(stream, "k", "ts", "event_id", 60, 100, table, checkpoint, ended=number == 2, large_rows=60)
        if number == 1:
            clock = spark.read.parquet(f"{table}-clock/batch_id=1").first()["now"]
            waiting = spark.read.parquet(f"{table}-waiting/batch_id=1").collect()
            assert waiting and all(r["ts"] > clock for r in waiting)
            assert all(r["_start"] + datetime.timedelta(seconds=60) > clock
                       for r in spark.read.parquet(f"{table}-open/batch_id=1").collect())
    found = {r["event_id"]: r["window_start"] for r in jobs.read_table(spark, table).collect()}
    assert found == anchored(events, 60)
    assert sorted(r["event_id"] for r in jobs.late_rows(spark, table).collect()) == [900, 901]


# -- stored reports -------------------------------------------------------------------------------------


def parts(spark, made):
    """A check that notes what it was asked to make; URLs with ``safe`` are allow-listed."""

    def make(frame):
        made.extend(map(tuple, frame.select("url", "computed_at").collect()))
        return frame.withColumn("report", F.concat(F.lit("report of "), "url")).drop("url")

    def allow(frame):
        return frame.withColumn("whitelisted", F.col("url").contains("safe"))

    return make, allow


def test_reports_are_reused_until_they_expire(spark, tmp_path):
    made = []
    make, allow = parts(spark, made)
    store = reports.report_table(spark, str(tmp_path / "store"), digits=1)
    schema = "event_id int, url string, ts timestamp"

    def ask(batch, *requests):
        made.clear()
        frame = spark.createDataFrame(list(requests), schema)
        found = reports.serve(frame, make, allow, store, batch, 600).collect()
        assert all(r["report"] == f"report of {r['url']}" for r in found)
        return {r["event_id"]: (r["computed_at"], r["reused"]) for r in found}

    first = [(1, "u", at(0)), (2, "u", at(599)), (3, "u", at(600)), (4, "safe", at(0)), (5, "safe", at(1)),
             (6, None, at(0)), (7, "", at(0)), (8, "v", at(50)), (9, "w", None)]
    wanted = {1: (at(0), False), 2: (at(0), True), 3: (at(600), False), 4: (at(0), False), 5: (at(1), False),
              8: (at(50), False), 9: (None, False)}
    assert ask(0, *first) == wanted
    assert sorted(made, key=repr) == sorted([("u", at(0)), ("u", at(600)), ("v", at(50)), ("safe", None), ("w", None)], key=repr)
    # The same requests again: all that may be stored is read.
    again = ask(1, *first)
    assert {i: t for i, (t, _) in again.items()} == {i: t for i, (t, _) in wanted.items()}
    assert {i for i, (_, reused) in again.items() if reused} == {1, 2, 3, 8} and sorted(m[0] for m in made) == ["safe", "w"]
    # Later, and earlier than anything stored.
    assert ask(2, (1, "u", at(1199)), (2, "u", at(1200)), (3, "u", at(1300)), (4, "u", at(-10)), (5, "v", at(649)), (6, "v", at(650))) == {
        1: (at(600), True), 2: (at(1200), False), 3: (at(1200), True), 4: (at(-10), False), 5: (at(50), True), 6: (at(650), False)}
    # A batch that runs again does not see its own reports.
    assert ask(2, (1, "u", at(1200)))[1] == (at(1200), False)
    store.compact(1, reports.unexpired(F.lit(at(1200)), 600))
    assert sorted(r["computed_at"] for r in store._read(["base-1"]).collect()) == []
    assert store.read().where("report LIKE '%safe%'").count() == 0


def test_no_requests(spark, tmp_path):
    make, allow = parts(spark, [])
    store = reports.report_table(spark, str(tmp_path / "store"), digits=1)
    empty = spark.createDataFrame([], "event_id int, url string, ts timestamp")
    assert reports.serve(empty, make, allow, store, 0, 600).count() == 0 and store.read().count() == 0
