"""Ingest: the written facts hold exactly the lazily derived rows, laid out by year."""

import os

from pyspark.sql import functions as F

from fieldreports.sources import FactSource

from .conftest import SF_SMALL


def _digest(df):
    cols = sorted(c for c in df.columns)
    return df.select(F.sum(F.xxhash64(*[F.col(c) for c in cols]) % 1000003).alias("h"), F.count(F.lit(1)).alias("n")).first()


def test_written_equals_lazy(spark, written_source):
    lazy = FactSource(spark, SF_SMALL)
    for name in ("attendance", "visits"):
        a = getattr(lazy, name)()
        b = getattr(written_source, name)()
        assert sorted(a.columns) == sorted(b.columns)
        b = b.select(*a.columns)
        assert _digest(a) == _digest(b)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _files(path):
    """(file, first day, last day) by the statistics in the footers."""
    import pyarrow.parquet as pq

    out = []
    for base, _, names in os.walk(path):
        for name in sorted(n for n in names if n.endswith(".parquet")):
            meta = pq.read_metadata(os.path.join(base, name))
            column = meta.schema.to_arrow_schema().get_field_index("date_d")
            stats = [meta.row_group(i).column(column).statistics for i in range(meta.num_row_groups)]
            out.append((os.path.join(base, name), min(x.min for x in stats), max(x.max for x in stats)))
    return out


def test_files_hold_narrow_day_ranges(spark):
    """A one-day filter meets only files that hold the day, whatever order the
    days arrive in; a hot day is split."""
    import datetime as dt

    from fieldreports.session import scratch_path
    from fieldreports.sources import ingest

    day = F.when(F.col("id") % 3 == 0, F.lit(200)).otherwise(F.pmod(F.xxhash64("id"), F.lit(365))).cast("int")
    df = spark.range(0, 60_000, 1, 16).select("id", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("date_d")).withColumn("year", F.year("date_d"))
    path = scratch_path(spark, "layout")
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        ingest.write_fact(df, path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = _files(path)
    assert len(files) >= 8 and ingest.read_fact(spark, path).count() == 60_000
    quiet = dt.date(2024, 3, 1)
    assert sum(a <= quiet <= b for _, a, b in files) <= 2  # of all; neighbours may share a day
    hot = dt.date(2024, 1, 1) + dt.timedelta(days=200)
    assert sum(a <= hot <= b for _, a, b in files) >= 2
    assert sum((b - a).days for _, a, b in files) <= 365 + len(files)


def test_sorted_files_by_year(written_source):
    (part,) = written_source.store("visits").parts()
    path = f"{written_source.path('visits')}/rows/part={part.name}"
    years = sorted(d for d in os.listdir(path) if d.startswith("year="))
    assert years and all(d[5:].isdigit() for d in years)
    df = written_source.visits()
    one = df.where(F.col("year") == int(years[0][5:])).select("date_d", F.input_file_name().alias("f"))
    for f in {r.f for r in one.select("f").distinct().collect()}:
        days = [r.date_d for r in one.where(F.col("f") == f).collect()]
        assert days == sorted(days)


def test_shared_source_is_per_session_and_writes_what_is_asked_for(spark, tmp_path):
    a = FactSource.shared(spark, SF_SMALL)
    b = FactSource.shared(spark, SF_SMALL + "/")
    assert a is b and a.attendance() is b.attendance()
    lazy = FactSource.shared(spark, SF_SMALL, written=False)
    assert lazy is not a and lazy.base is None
    one = FactSource(spark, SF_SMALL, str(tmp_path / "facts"))
    one.visits()
    assert os.listdir(tmp_path / "facts") == ["visits"]


def test_later_sessions_write_nothing(spark, tmp_path):
    base = str(tmp_path / "facts")
    first = FactSource(spark, SF_SMALL).materialise(base)
    stamps = {f: os.stat(f).st_mtime_ns for f, _, _ in _files(base)}
    spark.conf.set("spark.fieldreports.facts.dir", base)
    try:
        later = spark.newSession()
        again = FactSource.shared(later, SF_SMALL)
        assert again.visits().count() == first.visits().count() == 6000
        assert again.attendance().count() == first.attendance().count()
    finally:
        spark.conf.unset("spark.fieldreports.facts.dir")
    again2 = FactSource(spark, SF_SMALL, base)
    assert again2.visits().count() == 6000
    assert {f: os.stat(f).st_mtime_ns for f, _, _ in _files(base)} == stamps


def test_interrupted_writes_are_written_anew(spark, tmp_path):
    base = str(tmp_path / "facts")
    os.makedirs(f"{base}/visits/rows/part=w0/year=1995")
    (tmp_path / "facts/visits/rows/part=w0/year=1995/part-0.parquet").write_bytes(b"half a file")
    assert FactSource(spark, SF_SMALL, base).visits().count() == 6000


def test_a_failing_write_is_an_error(spark, monkeypatch):
    import pytest

    from fieldreports.sources import ingest

    def broken(*args, **kwargs):
        raise OSError("read-only checkpoint folder")

    monkeypatch.setattr(ingest, "write_fact", broken)
    with pytest.raises(OSError, match="read-only"):
        FactSource(spark, SF_SMALL, "/tmp/never-written-facts").visits()


def test_a_stray_day_adds_one_day(spark, tmp_path):
    """An event in 1970 gives every employee one more day, not a range of them."""
    from fieldreports.sources import fixtures
    from fieldreports.sources.tables import TABLE_NAMES

    for t in TABLE_NAMES:
        if t != "events":
            os.symlink(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    stray = events.limit(1).withColumn("ts", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    events.unionByName(stray).write.parquet(str(tmp_path / "events.parquet"))
    before = fixtures.attendance(spark, SF_SMALL)
    after = fixtures.attendance(spark, str(tmp_path))
    users = before.select("user_id").distinct().count()
    assert after.count() == before.count() + users
    assert "sequence(" not in after._jdf.queryExecution().optimizedPlan().toString()


def test_checkpoint_dir_read_from_session(spark):
    from fieldreports.session import ensure_checkpoint_dir, scratch_path

    base = ensure_checkpoint_dir(spark)
    assert base == (spark.conf.get("spark.checkpoint.dir", None) or base)
    p1, p2 = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert p1 != p2 and p1.startswith(base.rstrip("/"))


def test_clusters_need_a_shared_checkpoint_folder():
    import pytest

    from fieldreports.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_write_without_shuffle_same_rows(spark, written_source):
    from fieldreports.session import scratch_path
    from fieldreports.sources import ingest

    lazy = FactSource(spark, SF_SMALL)
    path = scratch_path(spark, "visits-noshuffle")
    ingest.write_fact(lazy.visits(), path, shuffle=False)
    b = ingest.read_fact(spark, path)
    a = written_source.visits()
    assert _digest(a.select(*sorted(a.columns))) == _digest(b.select(*sorted(a.columns)))
