"""CSV members of zip archives: encodings by member, large members, and errors that name the file."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from weekloom.sources import archives

SCHEMA = "k long, name string, price double"


def test_members_of_two_encodings(spark, tmp_path):
    text = "name,other,k,price\n{0},x,{1},2.5\n\"a, \"\"b\"\"\nline {0}\",y,{2},\n,z,bad,3\n"
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("first.csv", text.format("서울", 1, 2).encode("cp949"))
        z.writestr("folder/SECOND.CSV", text.format("부산 ☃", 3, 4).encode("utf-8"))
        z.writestr("notes.txt", b"\xff\xfe not read")
    with zipfile.ZipFile(tmp_path / "two.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("empty.csv", "k,name,price\n")
    rows = archives.read_zipped_csv(spark, str(tmp_path), SCHEMA, source="member").collect()
    got = sorted(((r.member.rpartition("!")[2], r.k, r.name, r.price) for r in rows), key=str)
    want = []
    for member, city, a, b in (("first.csv", "서울", 1, 2), ("folder/SECOND.CSV", "부산 ☃", 3, 4)):
        want += [(member, a, city, 2.5), (member, b, f'a, "b"\nline {city}', None), (member, None, None, 3.0)]
    assert got == sorted(want, key=str)
    assert all(r.member.endswith(("one.zip!first.csv", "one.zip!folder/SECOND.CSV")) for r in rows)


def test_member_larger_than_a_batch(spark, tmp_path, monkeypatch):
    """The second encoding is found only at the end of the member, many pieces in."""
    body = "".join(f"{k},name {k} 서울,{k / 4}\n" for k in range(120_000)) + "120000,☃,1\n"
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.csv", ("k,name,price\n" + body).encode("utf-8"))
    assert len(body.encode()) > 2 * archives.PIECE
    rows = archives.read_zipped_csv(spark, str(tmp_path / "big.zip"), SCHEMA, encodings=("ascii", "cp949", "utf-8"))
    one = rows.agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.sum("price").alias("p"), F.max(F.when(F.col("k") == 120_000, F.col("name"))).alias("last")).first()
    assert (one.n, one.k, one["last"]) == (120_001, 120_000 * 120_001 // 2, "☃") and one.p == pytest.approx(sum(k / 4 for k in range(120_000)) + 1)


@pytest.mark.parametrize("case", ["broken", "column", "encoding"])
def test_errors_name_the_file(spark, tmp_path, case):
    path = tmp_path / f"{case}.zip"
    if case == "broken":
        path.write_bytes(b"PK\x03\x04 no archive")
    else:
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("member.csv", "k,name\n1,a\n" if case == "column" else b"k,name,price\n1,\xff\xff,2\n")
    with pytest.raises(Exception, match=f"can't read .*{case}.zip" + ("" if case == "broken" else "!member.csv")):
        archives.read_zipped_csv(spark, str(path), SCHEMA).collect()


def test_round_trip(spark, tmp_path):
    """Partitions become archives; an empty partition leaves none, and unknown characters are an error."""
    df = spark.range(0, 5000, numPartitions=4).select(F.col("id").alias("k"), F.concat(F.lit('q"u,o\n서울 '), F.col("id").cast("string")).alias("name"), (F.col("id") / 8).alias("price"))
    paths = archives.write_zipped_csv(df.where("k >= 1250"), f"file://{tmp_path}/out", encoding="cp949")
    assert len(paths) == 3 and len(list((tmp_path / "out").iterdir())) == 3
    back = archives.read_zipped_csv(spark, paths, SCHEMA)
    assert back.exceptAll(df.where("k >= 1250")).count() == 0 and back.count() == 3750
    with pytest.raises(Exception, match="can't encode"):
        archives.write_zipped_csv(df.select(F.lit("☃").alias("name")), f"file://{tmp_path}/bad", encoding="cp949")
