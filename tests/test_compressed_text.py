"""Compressed text files: the same lines and rows, little disk, partitions by the size of the text."""

from pathlib import Path

from conftest import SF_SMALL
from flowbook.plans import pipeline as PL
from flowbook.plans import queries as Q
from flowbook.plans import sinks as K
from flowbook.sources import fixtures as FXT


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if not p.name.endswith(".crc"))


def lines(spark, path):
    return sorted(r.value for r in spark.read.text(path).collect())


def test_compressed_files_hold_the_same_lines(spark, tmp_path):
    plain, packed = FXT.write_files(spark, SF_SMALL, str(tmp_path / "a")), FXT.write_files(spark, SF_SMALL, str(tmp_path / "b"), compression="gzip")
    assert plain.keys() == packed.keys() and all(lines(spark, plain[k]) == lines(spark, packed[k]) for k in plain)
    assert PL.text.read_analysis_date(spark, packed["time"]) == FXT.FIXTURE_T0
    run = lambda f, **kw: PL.run(spark, f["contracts"], factors_path=f["factors"], time_spec_path=f["time"], sink="text", output=f["contracts"] + "-out", **kw)
    run(plain), run(packed, compression="gzip")
    a, b = plain["contracts"] + "-out", packed["contracts"] + "-out"
    assert lines(spark, a) == lines(spark, b) and size(b) * 4 < size(a)
    assert sorted(map(str, K.read_text(spark, a).collect())) == sorted(map(str, K.read_text(spark, b).collect()))


def test_partitions_follow_the_text_in_compressed_files(spark, tmp_path):
    for name in ("a.csv.gz", "b.csv"):
        with (tmp_path / name).open("wb") as f:
            f.truncate(100 << 20)
    need = PL.EVENT_BYTES_PER_LINE_BYTE * 100 / 64
    assert PL.partitions_for(spark, str(tmp_path / "a*")) >= 4 * need > 30
    assert PL.partitions_for(spark, str(tmp_path / "b*")) <= need + 1


def test_run_text_keeps_little_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "shared_dir", lambda spark: str(tmp_path))
    n = Q.q_run_text(spark, SF_SMALL).count()
    assert n == Q.present(Q.pam(spark, SF_SMALL)).count()
    assert size(tmp_path) < 30 * n  # the sink's text alone has over 60 bytes an event
