"""C# sources, TFRecord files and the merging sink."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from semid.sources import merging
from semid.sources.csharp import csharp_types, type_blob, types, whole_types
from semid.sources.tfrecord import TFRecordSource, checksum, encode_example, first_frame, frame

SOURCE = r'''
using System; // class Fake1 { }
/* class Fake2 { void M() {} } */
#region class Fake3 {
namespace Depot.Core {
  [Note("class Fake4 { }"), Other(typeof(List<int>))]
  public partial class Shelf<T> : Rack<T, int>, IPlace where T : new() {
    private static readonly Dictionary<string, List<int>> map = new Dictionary<string, List<int>>(), other = null;
    const string S = "} class Fake5 {", V = @"""} class Fake6 { \", I = $"{(a > 0 ? "x}" : "{")} }}";
    char c = '{'; int[] row = { 1, 2 }; int a, b = 3;
    public event Action Moved;
    public int Count { get; set; } = 5;
    public int Twice => Count * 2;
    public Shelf(int x) : base(x) { if (x > 0) { } }
    ~Shelf() { }
    public static Shelf<T> operator +(Shelf<T> a, Shelf<T> b) => a;
    public int this[int i] { get { return i; } }
    public async Task<List<T>> Load<U>(Func<int, U> f) where U : class { var z = "}"; void Local() { } }
    (int x, string y) Pair(int q = 1) => (q, "a;b");
    void IPlace<T>.Put() { }
    protected abstract void Take();
    delegate void D(int x);
    enum Color { Red, Green = 2 }
    struct Slot { public int v; void Go() {} class Deep { string? n; } }
    bool less = 1 < 2, more = false;
    string raw = """
      class Fake7 { " }
      """;
  }
  interface IPlace<T> { void Put(); int Prop { get; } }
  record Point(int X, int Y) : Shape(X) { public double Len() => 0; }
  public record struct Size(int A);
}
'''


def test_types_that_patterns_get_wrong():
    got = [(t.name, t.kind, t.parent, t.methods, t.fields) for t in types(SOURCE)]
    assert got == [
        ("Shelf", "class", "Rack<T,int>", ["Load", "Pair", "Put", "Take"], ["map", "other", "S", "V", "I", "c", "row", "a", "b", "less", "more", "raw"]),
        ("Color", "enum", None, [], []), ("Slot", "struct", None, ["Go"], ["v"]), ("Deep", "class", None, [], ["n"]),
        ("IPlace", "interface", None, ["Put"], []), ("Point", "record", "Shape", ["Len"], []), ("Size", "record", None, [], []),
    ]
    assert {t.namespace for t in types(SOURCE)} == {"Depot.Core"}
    deep = next(t for t in types(SOURCE) if t.name == "Deep")
    assert SOURCE[deep.start : deep.end] == "class Deep { string? n; }"


@pytest.mark.parametrize("text", ["", "class", "class X { void A( { ", "}}} class Y { int z; }", 'class Q { string s = "abc\n; int k; }', "namespace A.B;\nclass D:E{}", "$\"{", "'", "/*", "record r = 1;", "[", "class A<", "(" * 5000, "class A {" * 200])
def test_broken_sources_end(text):
    assert isinstance(types(text), list)


def test_any_cut_of_a_source_ends():
    rng = random.Random(1)
    for _ in range(150):
        a, b = sorted(rng.sample(range(len(SOURCE)), 2))
        types(SOURCE[a:b] + SOURCE[rng.randrange(len(SOURCE)) :])


def test_partial_types_and_blobs(spark):
    files = spark.createDataFrame([("b.cs", "namespace N.X; partial class P : Base { void Two() {} }"), ("a.cs", "namespace N.X { partial class P { int one; } class Alone {} }"), ("c.cs", "namespace Other { class Z {} }"), ("d.cs", None)], "rel_path string, text string")
    found = csharp_types(files, roots=("N",))
    rows = {r["name"]: r for r in whole_types(found).collect()}
    assert set(rows) == {"P", "Alone"} and (rows["P"]["parent"], rows["P"]["methods"], rows["P"]["fields"], rows["P"]["parts"]) == ("Base", ["Two"], ["one"], 2)
    blob = whole_types(found).where("name = 'P'").select(type_blob(*map(F.col, ("kind", "namespace", "name", "parent", "methods", "fields")))).first()[0]
    assert blob == "class N.X.P : Base\nmethods: Two\nfields: one"


def test_frames_have_checksums():
    assert checksum(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    assert struct.unpack("<Q", frame(b"abc")[:8]) == (3,)


def test_large_files_are_read_in_parts(spark, tmp_path):
    rng = random.Random(2)
    rows = [{"id": [i], "name": [f"n{i % 7}"], "xs": [rng.random() for _ in range(rng.randrange(40))]} for i in range(800)]
    data = b"".join(frame(encode_example(r)) for r in rows)
    (tmp_path / "a.tfrecord").write_bytes(data)
    starts, at = [], 0
    for r in rows:
        starts.append(at)
        at += len(frame(encode_example(r)))
    with open(tmp_path / "a.tfrecord", "rb") as f:
        for begin in (0, 1, 777, 5000):
            assert first_frame(f, len(data), begin, len(data)) == next(s for s in starts if s >= begin)
    spark.dataSource.register(TFRecordSource)
    read = spark.read.format("tfrecord").option("splitBytes", "3000").load(str(tmp_path / "*.tfrecord"))
    assert dict(read.dtypes) == {"id": "array<bigint>", "name": "array<binary>", "xs": "array<float>"}
    assert read.rdd.getNumPartitions() == -(-len(data) // 3000)
    assert sorted(r["id"][0] for r in read.collect()) == list(range(800))
    (tmp_path / "b.tfrecord").write_bytes(data[:0] + struct.pack("<Q", 2) + b"\0\0\0\0" + encode_example({})[:2] + b"\0\0\0\0")
    assert spark.read.format("tfrecord").schema("id bigint").option("splitBytes", "9").load(str(tmp_path / "b.tfrecord")).count() == 1


def test_comparisons_are_pushed_down(spark, tmp_path):
    (tmp_path / "a.tfrecord").write_bytes(b"".join(frame(encode_example({"id": [i], "name": [f"n{i % 3}"]} if i % 5 else {"id": [i]})) for i in range(60)))
    spark.dataSource.register(TFRecordSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = spark.read.format("tfrecord").option("pushdown", "true").schema("id bigint, name string").load(str(tmp_path / "a.tfrecord"))
        got = read.where("id >= 10 and id < 40 and name = 'n1'")
        assert sorted(r["id"] for r in got.collect()) == [i for i in range(10, 40) if i % 5 and i % 3 == 1]
        assert "Filter (" not in got._jdf.queryExecution().executedPlan().toString()
        assert read.where("name is null").count() == 12
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_merging_sink(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    df = spark.range(1000).selectExpr("id", "id % 7 g").repartition(9)
    out = merging.write_merged(df, path, post=(lambda x: x.groupBy("g").count(), lambda x: x.where("g < 3")))
    assert {(r["g"], r["count"]) for r in out.collect()} == {(0, 143), (1, 143), (2, 143)}
    assert len(merging.files(path)) == 1 and spark.read.parquet(path).count() == 1000
    merging.write_merged(df.limit(10), path, mode="append", file_bytes=100)
    assert spark.read.parquet(path).count() == 1010 and len(merging.files(path)) > 1
    merging.write_merged(df.limit(3), path)
    assert spark.read.parquet(path).count() == 3 and not list((tmp_path / "out" / "_staged").glob("*"))
    assert merging.write_merged(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(merging.MergedSink)
    bad = spark.range(100).repartition(4).selectExpr("if(id = 77, raise_error('no'), id) as id")
    with pytest.raises(Exception, match="no"):
        bad.write.format("merged").mode("append").save(f"file://{tmp_path}/bad")
    assert merging.files(f"file://{tmp_path}/bad") == []
    attempts = merging._Writer(f"file://{tmp_path}/twice", False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [1, 2]})
    first, second = attempts.write(iter([batch])), attempts.write(iter([batch]))
    assert first.name != second.name
    attempts.commit([second])
    assert spark.read.parquet(f"{tmp_path}/twice").count() == 2
