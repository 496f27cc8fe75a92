"""Shuffle partitions follow the size of the input."""
from trailweave import session
from trailweave.catalog.registry import tables_for


def test_large_input_gets_more_partitions(spark, tmp_path, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        (tmp_path / "part.parquet").mkdir()
        (tmp_path / "part.parquet" / "x").write_bytes(b"0" * 1000)
        monkeypatch.setattr(session, "PARTITION_BYTES", 100)
        tables_for(spark, str(tmp_path))
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 10
        monkeypatch.setattr(session, "PARTITION_BYTES", 1000)
        assert session.fit_partitions(spark, str(tmp_path)) == 10  # a higher setting stays
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_joined_partitions_stay_small_unless_a_size_is_set(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.unset(session.ADVISORY)
        session.fit_partitions(spark, str(tmp_path))
        assert spark.conf.get(session.ADVISORY) == str(session.JOINED_BYTES)
        spark.conf.set(session.ADVISORY, "1m")
        session.fit_partitions(spark, str(tmp_path))
        assert spark.conf.get(session.ADVISORY) == "1m"
    finally:
        spark.conf.unset(session.ADVISORY)
        spark.conf.set("spark.sql.shuffle.partitions", before)
