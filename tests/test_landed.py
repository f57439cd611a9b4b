"""Landed files as a data source: kinds, ranges, comparisons, bad rows, and growing files as a stream."""

import datetime as dt
import json

import pytest

from loomwork.sources import landed as L

SCHEMA = f"id string, n bigint, at date, v double, tags array<string>, {L.ORIGIN}"


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    L.register(spark)


def lines(spark, path, kind="jsonl", schema=SCHEMA, **options):
    reader = spark.read.format("landed").option("kind", kind).schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(str(path))


GOOD = {"ID": "a", "n": 3, "at": "2024-01-31", "v": 1, "tags": ["x", "y"], "more": 1}


def test_rows_and_reasons(spark, tmp_path):
    odd = [json.dumps(GOOD), "{", "[1]", json.dumps({"id": 5, "n": None}), json.dumps({"n": "12", "v": "1e3"}), json.dumps({"n": 1.5}), json.dumps({"at": "2024-02-31"}), json.dumps({"n": 1 << 63}), "", json.dumps({"tags": "x"}), "{}"]
    (tmp_path / "a.json").write_bytes("\r\n".join(odd).encode() + b"\n\xff\xfe\n" + b'{"id": "last"}')
    (tmp_path / "_hidden").write_text("{")
    got = lines(spark, tmp_path).orderBy("_at").collect()
    assert [r._bad for r in got] == [None, "not_json", "not_an_object", None, None, "bad_n", "bad_at", "bad_n", "bad_tags", None, "not_utf8", None]
    assert (got[0].id, got[0].n, got[0].at, got[0].v, got[0].tags) == ("a", 3, dt.date(2024, 1, 31), 1.0, ["x", "y"])
    assert (got[3].id, got[4].n, got[4].v, got[-1].id) == ("5", 12, 1000.0, "last")
    assert all(r.id is None and r.n is None for r in got if r._bad)


@pytest.mark.parametrize("split", [1, 7, 100, 1 << 20])
def test_ranges_of_any_size_give_each_line_once(spark, tmp_path, split):
    text = "".join(json.dumps({"id": "é" * (i % 9), "n": i}, ensure_ascii=False) + "\n" for i in range(40))
    (tmp_path / "a").write_text(text + '{"n": 40}')
    (tmp_path / "empty").write_text("")
    rows = L.Rows({"path": str(tmp_path)}, spark.createDataFrame([], f"id string, n bigint, {L.ORIGIN}").schema)
    size = len((text + '{"n": 40}').encode())
    got = [b for at in range(0, size, split) for b in rows.read(L.Part(str(tmp_path / "a"), at, min(at + split, size), False))]
    assert sorted(n for b in got for n in b.column("n").to_pylist()) == list(range(41))
    if split > 7:
        assert lines(spark, tmp_path, split_bytes=split).count() == 41


def test_csv_and_xml(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_text('# source: x\nperiod,value,name\n2017-01-01,97.5,"a, b"\n# more\n2017-02-01,,c\nbad\nnodate,1,d\n')
    got = lines(spark, tmp_path / "c", "csv", f"period date, value double, name string, {L.ORIGIN}").orderBy("_at").collect()
    assert [(r.period and r.period.month, r.value, r.name, r._bad) for r in got] == [(1, 97.5, "a, b", None), (2, None, "c", None), (None, None, None, "wrong_number_of_values"), (None, None, None, "bad_period")]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.xml").write_text('<m xmlns="u"><Series INDICATOR="I" FREQ="M"><Obs TIME_PERIOD="2017-01" OBS_VALUE="97.47"/><Obs TIME_PERIOD="2017-02" OBS_VALUE="NA"/></Series><Series INDICATOR="J"><Obs TIME_PERIOD="2017-03"/></Series></m>')
    (tmp_path / "x" / "b.xml").write_text("<m><Obs TIME_PERIOD='1'/><broken")
    got = lines(spark, tmp_path / "x", "xml", f"indicator string, freq string, time_period string, obs_value double, {L.ORIGIN}").orderBy("_file", "_at").collect()
    assert [(r.indicator, r.freq, r.time_period, r.obs_value, r._bad) for r in got] == [("I", "M", "2017-01", 97.47, None), (None, None, None, None, "bad_obs_value"), ("J", None, "2017-03", None, None), (None, None, "1", None, None), (None, None, None, None, "not_xml")]


def test_comparisons_are_made_in_the_source(spark, tmp_path):
    for kind in ("a", "b c"):
        folder = tmp_path / f"kind={kind}"
        folder.mkdir()
        (folder / "f").write_text("".join(json.dumps({"n": i if i % 5 else None, "id": f"x{i}"}) + "\n" for i in range(20)) + "{\n")
    df = lines(spark, tmp_path, schema=f"kind string, id string, n bigint, v double, {L.ORIGIN}")
    every = df.cache().collect()
    for condition, keep in (
        ("n > 7", lambda r: (r.n or 0) > 7), ("n IS NULL", lambda r: r.n is None), ("n IN (1, 2)", lambda r: r.n in (1, 2)), ("kind = 'b c' AND n <= 3", lambda r: r.kind == "b c" and r.n is not None and r.n <= 3),
        ("id LIKE 'x1%'", lambda r: (r.id or "").startswith("x1")), ("_bad IS NOT NULL", lambda r: r._bad is not None), ("n = 3 OR id = 'x4'", lambda r: r.n == 3 or r.id == "x4"), ("v > 1", lambda r: False),
    ):
        fresh = lines(spark, tmp_path, schema=f"kind string, id string, n bigint, v double, {L.ORIGIN}").where(condition)
        assert sorted(map(str, fresh.collect())) == sorted(str(r) for r in every if keep(r)), condition
    reader = L.LandedReader({"path": str(tmp_path)}, df.schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("kind",), "a"), GreaterThan(("v",), 1.0)]))
    assert len(left) == 1 and [p.file.split("kind=")[1][0] for p in reader.partitions()] == ["a"]


def test_a_growing_log_as_a_stream(spark, tmp_path):
    log, out, progress = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "progress")
    log.mkdir()
    schema = f"n bigint, {L.ORIGIN}"

    def take():
        stream = spark.readStream.format("landed").option("kind", "jsonl").schema(schema).load(str(log))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(once=True).start().awaitTermination()
        return sorted(r.n for r in spark.read.schema(schema).parquet(out).collect())

    with (log / "a").open("a") as f:
        f.write('{"n": 1}\n{"n": 2')
    assert take() == [1]  # the second line is not finished
    with (log / "a").open("a") as f:
        f.write('}\n{"n": 3}\n')
    (log / "b").write_text('{"n": 4}\n')
    assert take() == [1, 2, 3, 4]
    assert take() == [1, 2, 3, 4]


def test_nothing_there(spark, tmp_path):
    assert lines(spark, tmp_path).count() == 0
    with pytest.raises(Exception, match="(?i)not.?found|nowhere"):
        lines(spark, tmp_path / "nowhere").count()
    with pytest.raises(Exception, match="kind is one of"):
        (tmp_path / "a").write_text("x\n")
        lines(spark, tmp_path, "parquet").count()
