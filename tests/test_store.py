import os
import random

import pytest
from pyspark.sql import functions as F

from quern import cli
from quern.functions import paths, table_text
from quern.operators import chunking, codecs, constraints
from quern.plans import measure, migration, store
from quern.sources import delimited, files


def frame(spark, entries):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in entries.items()], "path string, content binary")


@pytest.fixture(scope="module")
def entries():
    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(9000))
    out = {"a.bin": noise + b"common" * 1000, "b/empty": b"", "b/same.bin": noise + b"common" * 1000, "text.txt": b"line of text\n" * 3000, "self.bin": b"x" * 40960, "png.png": b"\x89PNG\r\n\x1a\n" + noise, "Ünï/c.md": b"# t\n"}
    return out | {f"m{i}.py": "".join(f"def function_{i}_{rng.randrange(10**9)}(value):\n    return value + {rng.randrange(10**6)}\n\n" for _ in range(40)).encode() for i in range(12)}


@pytest.fixture(scope="module")
def packed(spark, entries, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("d") / "set")
    folders = spark.createDataFrame([("b",), ("Ünï",), ("hollow",)], "path string")
    store.pack(frame(spark, entries), store.Options(profile="source", goal="avoid-zlib", chunk_size=4096), folders).save(path)
    return path


def test_round_trip(spark, entries, packed):
    d = store.open_dataset(spark, packed)
    assert {r.path: bytes(r.content) for r in store.extract(d).collect()} == entries
    assert {r.path for r in store.extract(d, ["b"]).collect()} == {"b/empty", "b/same.bin"}
    assert store.extract(d, ["nowhere"]).collect() == []
    assert constraints.verify(d).collect() == []
    with pytest.raises(FileExistsError):
        d.save(packed)


def test_dedup_and_reports(spark, entries, packed):
    d = store.open_dataset(spark, packed)
    info = store.inspect_dataset(d).first()
    assert info.file_count == len(entries) and info.original_size == sum(map(len, entries.values())) and info.unique_chunk_count < info.chunk_count
    rows = {r.path: r for r in store.list_files(d).collect()}
    assert rows["b/same.bin"].deduplicated and rows["self.bin"].deduplicated and not rows["text.txt"].deduplicated
    assert rows["b/empty"].packed_contribution == 0 and sum(r.packed_contribution for r in rows.values()) == pytest.approx(info.payload_size, abs=1e-3)
    owner = d.file_chunks.where("path = 'b/same.bin'").select("reused").distinct().collect()
    assert [r.reused for r in owner] == [True]
    assert d.files.where("path = 'png.png'").first().preferred_codec == "store"
    assert d.dictionaries.count() == 1 and d.dictionaries.first()["size"] <= 8192
    text = {r.path: r.text for r in store.explain(d).collect()}
    assert "Rejected candidates" in text["text.txt"] and "nothing (empty file)" in text["b/empty"] and "reuse" in text["b/same.bin"]


def test_same_input_same_tables(spark, entries):
    one, two = (store.dataset_digest(store.pack(frame(spark, entries).repartition(n), store.Options(chunk_size=4096))) for n in (1, 5))
    assert one == two


def test_every_rule_finds_its_mutation(spark, packed):
    d = store.open_dataset(spark, packed)
    first = d.chunks.agg(F.min("chunk_id")).first()[0]
    at = F.col("chunk_id") == first
    self_file = F.col("path") == "self.bin"
    changes = {
        "V1": {"manifest": d.manifest.limit(0)},
        "V3": {"manifest": d.manifest.withColumn("format_minor", F.lit(7))},
        "V4": {"manifest": d.manifest.withColumn("goal", F.lit("fastest"))},
        "V5": {"dictionaries": d.dictionaries.withColumn("size", F.lit(5).cast("long"))},
        "V6": {"source_dictionaries": d.source_dictionaries.withColumn("dictionary_id", F.lit("0" * 64))},
        "V7": {"chunks": d.chunks.withColumn("raw_size", F.when(at, F.lit(0).cast("long")).otherwise(F.col("raw_size")))},
        "V8": {"dictionaries": d.dictionaries.limit(0)},
        "V10": {"dictionaries": d.dictionaries.unionByName(d.dictionaries.select(F.sha2(F.lit(b"z"), 256).alias("dictionary_id"), F.lit(1).cast("long").alias("size"), F.lit(b"z").alias("data")))},
        "V12": {"files": d.files.withColumn("path", F.when(self_file, F.lit("../x")).otherwise(F.col("path")))},
        "V13": {"files": d.files.withColumn("hash", F.upper("hash"))},
        "V14": {"chunks": d.chunks.where(~at)},
        "V15": {"files": d.files.withColumn("encoded_size", F.col("encoded_size") + 1)},
        "V16": {"files": d.files.withColumn("transform", F.col("transform").withField("mode", F.lit("canonical")))},
        "V17": {"files": d.files.withColumn("size", F.col("size") + 1)},
        "V18": {"candidates": d.candidates.where("path <> 'self.bin'")},
        "V19": {"file_chunks": d.file_chunks.withColumn("reused", ~F.col("reused"))},
        "V20": {"files": d.files.withColumn("mode", F.lit(0o4755))},
        "V22": {"file_chunks": d.file_chunks.where(~at)},
        "V23": {"directories": spark.createDataFrame([("TEXT.txt",)], "path string")},
        "V24": {"directories": spark.createDataFrame([("text.txt/below",)], "path string")},
    }
    for rule, tables in changes.items():
        assert rule in {r["rule"] for r in constraints.violations(d.replaced(**tables)).select("rule").distinct().collect()}, rule
    assert {r["rule"] for r in constraints.limits(d, max_files=3, max_extract_size=10).collect()} == {"V2", "V21"}


def test_damaged_bytes(spark, packed):
    d = store.open_dataset(spark, packed)
    flipped = F.concat(F.substring("payload", 1, 10), F.lit(b"!"), F.substring(F.col("payload"), F.lit(12), F.octet_length("payload")))
    bad = d.replaced(chunks=d.chunks.withColumn("payload", flipped))
    assert {r["rule"] for r in constraints.damage(bad).collect()} >= {"chunk", "hash"}
    with pytest.raises(Exception, match="damaged chunk"):
        store.extract(bad).collect()


def test_seals(spark, packed, tmp_path):
    d = store.open_dataset(spark, packed)
    assert store.seal_status(d) == "intact" and store.inspect_dataset(d).first().seal == "intact"
    assert store.seal_status(store.Dataset(spark, d.tables)) == "none"
    changed = store.Dataset(spark, d.tables | {"files": d.files.withColumn("reason", F.lit("x"))}, packed)
    assert store.seal_status(changed) == "broken"
    with pytest.raises(OSError, match="bytes left"):
        store.write_tree(store.extract(d), str(tmp_path / "full"), needed=1 << 60)


def test_wide_integers(spark):
    from quern.operators import columns

    values = {"twenty": [f"{10**19 + 7 * i * i}" for i in range(50)], "falling": ["9" * 45, "5"], "wide": [f"{10**36 + i}" for i in range(9)]}
    for name, want in (("twenty", "delta"), ("falling", "plain"), ("wide", "delta")):
        df = spark.createDataFrame(list(enumerate(values[name])), "ordinal long, c string")
        assert columns.infer(df, "ordinal", ["c"]).first().encoding == want
        if want == "delta":
            steps = columns.differences(df, "ordinal", "c").rows().orderBy("ordinal").collect()
            n = list(map(int, values[name]))
            assert [int(r.n) for r in steps] == n and [int(r.d) for r in steps[1:]] == [b - a for a, b in zip(n, n[1:])]
            back = columns.undelta(steps[0].n, columns.differences(df, "ordinal", "c").rows()).orderBy("ordinal").collect()
            assert [int(r.n) for r in back] == n
        else:
            with pytest.raises(ValueError):
                columns.differences(df, "ordinal", "c")


def test_long_runs_unfold_in_pieces(spark, monkeypatch):
    from quern.operators import columns

    monkeypatch.setattr(columns, "PIECE", 7)
    runs = spark.createDataFrame([(0, "a", 20), (1, "b", 7), (2, "c", 1), (3, "d", 0)], "run long, value string, length long")
    assert [tuple(r) for r in columns.rle_decode(runs).orderBy("i").collect()] == list(enumerate("a" * 20 + "b" * 7 + "c"))


def test_spans(spark, packed):
    placed = chunking.chunk_offsets(store.open_dataset(spark, packed).chunks.join(chunking.owners(store.open_dataset(spark, packed).file_chunks.withColumn("raw_size", F.lit(0))).drop("raw_size"), "chunk_id")).cache()
    end = 16 + placed.agg(F.sum(F.col("packed_size") + 56)).first()[0]
    assert chunking.span_violations(placed, end).collect() == []
    assert chunking.span_violations(placed, end + 1).count() == 1
    assert chunking.span_violations(placed.withColumn("offset", F.col("offset") + F.when(F.col("offset") == 16, 0).otherwise(1)), end + 1).count() == 1


def test_migration(spark, packed, tmp_path):
    old = str(tmp_path / "old")
    legacy = migration.legacy_of(store.open_dataset(spark, packed))
    for name in ("files", "file_chunks", "chunks", "candidates", "source_dictionaries", "directories", "excluded", "manifest"):
        legacy.tables[name].write.parquet(f"{old}/{name}")
    assert migration.compatibility(spark, old)["migratable"] and migration.compatibility(spark, packed)["readable"]
    assert migration.compatibility(spark, str(tmp_path))["status"] == "unreadable"
    new = migration.migrate(spark, old, str(tmp_path / "new"))
    was = store.open_dataset(spark, packed)
    for name in ("files", "chunks", "candidates", "dictionaries", "source_dictionaries", "manifest"):
        assert store.table_digest(new.tables[name]).first() == store.table_digest(was.tables[name]).first(), name
    assert store.table_digest(new.file_chunks.drop("reason")).first() == store.table_digest(was.file_chunks.drop("reason")).first()
    unknown = migration.open_legacy(spark, old)
    assert migration.problems(unknown.replaced(manifest=unknown.manifest.withColumn("goal", F.lit("odd")))).count() == 1


CSV = b"timestamp,value,ok,status\r\n1,1.5,true,up\r\n2,1.50,false,up\r\n"


def test_tables_as_files(spark):
    d = store.pack(frame(spark, {"t.csv": CSV, "x.txt": b"x"}), store.Options(profile="telemetry", telemetry_mode="canonical", time_field="timestamp"))
    assert {r.path: bytes(r.content) for r in store.extract(d).collect()} == {"t.csv": b"timestamp,value,ok,status\n1,1.5,true,up\n2,1.5,false,up\n", "x.txt": b"x"}
    assert constraints.verify(d).collect() == []
    e = store.pack(frame(spark, {"t.CSV": CSV}), store.Options(profile="telemetry"))
    assert bytes(store.extract(e).first().content) == CSV and "timestamp: timestamp" not in e.files.first().transform.detected
    assert e.files.first().transform.applied == ["kept byte for byte"]


@pytest.mark.parametrize(("values", "want"), [(["1", "2", "3"], ("integer", "delta")), (["0", "1", "1"], ("boolean", "bit-pack")), (["007", "5"], ("integer", "plain")), (["", ""], ("string", "plain")), ([str(i) + "x" for i in range(17)], ("string", "plain")), ([f"v{i % 20}" for i in range(40)], ("string", "rle")), (["1.5", "nan"], ("float", "ieee-754")), (["True", "1"], ("boolean", "bit-pack"))])
def test_inference(spark, values, want):
    from quern.operators import columns

    assert table_text.infer_column(values) == want
    df = spark.createDataFrame(list(enumerate(values)), "ordinal long, c string")
    row = columns.infer(df, "ordinal", ["c"]).first()
    assert (row.type, row.encoding) == want


def test_table_documents_round_trip_and_damage():
    rng = random.Random(3)
    for _ in range(60):
        kinds = [lambda: rng.choice(["", "a", 'q"u,o', "é\nx"]), lambda: str(rng.randrange(50)), lambda: str(rng.random()), lambda: rng.choice(["true", "FALSE", ""]), lambda: ""]
        header = [f"c{i}" for i in range(rng.randrange(1, 5))]
        pick = [rng.choice(kinds) for _ in header]
        rows = [[p() for p in pick] for _ in range(rng.randrange(0, 40))]
        once = table_text.decode_table(table_text.encode_table(table_text.format_csv(header, rows), "c0")[0])
        assert table_text.decode_table(table_text.encode_table(once, "c0")[0]) == once
        assert len(table_text.parse_csv(once)[1]) == len(rows)
    assert table_text.decode_table(table_text.encode_table(b"t\n", "t")[0]) == b"t\n" and table_text.decode_table(table_text.encode_table(b"")[0]) == b""
    for bad in (b"a,b\n1\n", b"a\n\n", b"\xff\n"):
        with pytest.raises(table_text.TableError):
            table_text.encode_table(bad)
    document = table_text.encode_table(CSV)[0]
    for old, new in ((b'"rows":2', b'"rows":3'), (b'"up"]', b"]"), (b'"word"', b'"odd"'), (b"QCOLUMNS1", b"X"), (b"}", b"")):
        with pytest.raises(table_text.TableError):
            table_text.decode_table(document.replace(old, new, 1))


def test_codecs_and_choice(spark):
    for name in codecs.CODECS:
        assert codecs.unpack_bytes(name, codecs.pack_bytes(name, b"z" * 99), 99) == b"z" * 99
        with pytest.raises(Exception):
            codecs.unpack_bytes(name, codecs.pack_bytes(name, b"z" * 99), 98)
    big = frame(spark, {"big": b"x" * 1_000_000, "tiny": b"abc"})
    for goal in codecs.GOALS:
        c = codecs.candidates(big, goal)
        assert c.agg(F.max("sample_bytes")).first()[0] == 262_144
        best = {r.path: r.codec for r in codecs.choose(c).collect()}
        assert best["tiny"] == "store" and best["big"] in ("zstd", "zlib")
    assert {r.path: r.codec for r in codecs.choose(codecs.candidates(big, requested="zlib"), forced=True).collect()} == {"big": "zlib", "tiny": "zlib"}
    with pytest.raises(ValueError):
        codecs.candidates(big, "fastest")


def test_paths(spark):
    for bad in ("../escape", "/absolute", "C:\\drive", "\\\\server\\share", "bad\0name", "a/../b", "", "."):
        with pytest.raises(paths.UnsafePath):
            paths.normalize_path(bad)
        assert spark.createDataFrame([(bad,)], "p string").select(paths.normalized(F.col("p"))).first()[0] is None
    row = spark.createDataFrame([("a\\.\\b//c.PY",)], "p string").select(paths.normalized(F.col("p")).alias("p")).select("p", paths.category(F.col("p")), paths.ancestors(F.col("p")), paths.collision_key(F.lit("Straße"))).first()
    assert tuple(row) == ("a/b/c.PY", "python", ["a", "a/b"], "strasse")
    assert spark.range(1).select(paths.category(F.lit(".py")), paths.matches(F.lit("a/b.txt"), ["*.txt"]), paths.matches(F.lit("a/b.txt"), ["a"]), paths.matches(F.lit("a/b.txt"), ["?.txt", "[!a]*", "b"])).first()[0:4] == ("other", True, True, False)


def test_walk_read_and_write(spark, tmp_path):
    root = tmp_path / "tree"
    for p in ("src/app.py", ".git/config", "sub/.hidden", "sub/empty", "build/out"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(p.encode() if "empty" not in p else b"")
    (root / "link").symlink_to(root / "src")
    c = files.walk([str(root)], profile="source")
    assert [p for _, p, _ in c.files] == ["tree/src/app.py", "tree/sub/.hidden", "tree/sub/empty"] and c.excluded == ["tree/.git", "tree/build", "tree/link"]
    assert "tree/.git/config" in [p for _, p, _ in files.walk([str(root)], include=["*config", "*.py"]).files]
    with pytest.raises(ValueError):
        files.walk([str(root / "src/app.py"), str(root / "src/app.py")])
    listing, folders, _ = files.catalog_tables(spark, c)
    contents = files.read_contents(listing)
    assert {r.path: bytes(r.content) for r in contents.collect()} == {"tree/src/app.py": b"src/app.py", "tree/sub/.hidden": b"sub/.hidden", "tree/sub/empty": b""}
    out = str(tmp_path / "out")
    assert store.write_tree(contents, out, folders).count() == 3
    assert (tmp_path / "out/tree/sub/empty").read_bytes() == b""
    (tmp_path / "out/tree/src/app.py").write_bytes(b"other")
    with pytest.raises(Exception, match="FileExists"):
        store.write_tree(contents, out).count()
    assert store.write_tree(contents, out, overwrite=True).count() == 3


def test_csv_source(spark):
    cells = delimited.csv_cells(frame(spark, {"t.csv": b'a,a\n1,"x\ny"\n,2\n'})).orderBy("ordinal", "position").collect()
    assert [(r.ordinal, r.name, r.value) for r in cells] == [(0, "a", "1"), (0, "a", "x\ny"), (1, "a", ""), (1, "a", "2")]
    table = delimited.csv_table(frame(spark, {"t.csv": CSV}), ["timestamp", "ok"]).orderBy("ordinal").collect()
    assert [tuple(r) for r in table] == [("t.csv", 0, "1", "true"), ("t.csv", 1, "2", "false")]


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("hello " * 2000)
    d, out = str(tmp_path / "set"), str(tmp_path / "out")
    for argv in (["pack", str(src), "-o", d, "--chunk-size", "4k"], ["list", d, "--json"], ["inspect", d], ["verify", d], ["verify", d, "--quick"], ["explain", d], ["compatibility", d], ["unpack", d, "-o", out], ["extract", d, "in/a.txt", "-o", out, "--overwrite"], ["verify-deterministic", d, d], ["benchmark", str(src), "--repeats", "1", "--markdown", str(tmp_path / "b.md")], ["doctor"]):
        assert cli.main(argv) == 0, (argv, capsys.readouterr())
    assert (tmp_path / "out/in/a.txt").read_text() == "hello " * 2000
    assert cli.main(["pack", str(src), "-o", d]) == 2 and cli.main(["verify", str(tmp_path)]) == 2
    assert "raw-payload" in (tmp_path / "b.md").read_text()
    assert cli.size("2k") == 2048 and os.path.isdir(d)


def test_measurements(spark, entries):
    small = frame(spark, {k: entries[k] for k in ("text.txt", "b/empty")})
    rows = {r.name: r for r in measure.sweep(small).collect()}
    assert rows["store"].ratio == 1.0 and rows["zstd-9"].packed_size < rows["store"].packed_size
    table = measure.benchmark(small, repeats=1)
    assert {r["scope"] for r in table} == {"raw-payload", "tar-container", "full-dataset"} and "| raw-payload | store |" in measure.markdown(table)
