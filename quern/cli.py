"""Command line: python -m quern COMMAND ... Exit code 0 if all is well, 2 for any failure."""

from __future__ import annotations

import argparse
import json
import os
import platform
import sys
import tempfile
from collections.abc import Callable

from pyspark.sql import SparkSession

from quern.operators import chunking, codecs, constraints
from quern.plans import measure, migration, store
from quern.sources import files as source


def size(text: str) -> int:
    """A number of bytes, with k, m or g for powers of 1,024."""
    text = text.strip().lower()
    scale = {"k": 10, "m": 20, "g": 30}.get(text[-1:], 0)
    value = int(text[:-1] if scale else text) << scale
    if value <= 0:
        raise ValueError("a size must be positive")
    return value


def _session() -> SparkSession:
    return SparkSession.builder.appName("quern").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _read(spark: SparkSession, args: argparse.Namespace, target: str | None = None):
    catalog = source.walk(args.inputs, profile=args.profile, exclude=args.exclude, include=args.include, include_all=args.include_all, follow_symlinks=args.follow_symlinks, reserved=[target] if target else [])
    listing, folders, excluded = source.catalog_tables(spark, catalog)
    return source.read_contents(listing), folders, excluded


def _options(args: argparse.Namespace) -> store.Options:
    return store.Options(args.profile, args.goal, args.chunk_size, args.codec, args.level, args.store_permissions, args.telemetry_mode, args.time_field)


def _rows(df) -> list[dict]:
    return [r.asDict(True) for r in df.toLocalIterator()]


def pack(spark, args):
    contents, folders, excluded = _read(spark, args, args.dataset)
    store.pack(contents, _options(args), folders, excluded).save(args.dataset, args.overwrite)
    return _rows(store.inspect_dataset(store.open_dataset(spark, args.dataset)))[0]


def unpack(spark, args):
    d = store.open_dataset(spark, args.dataset)
    if args.verify and (bad := _rows(constraints.violations(d, max_files=args.max_files, max_chunks=args.max_chunks, max_extract_size=args.max_extract_size).limit(5))):
        raise ValueError(f"the dataset is not sound: {bad}")
    chosen = getattr(args, "paths", None) or []
    folders = d.directories.where(store.paths.selected(d.directories["path"], chosen))
    needed = d.files.where(store.paths.selected(d.files["path"], chosen)).agg({"size": "sum"}).first()[0] or 0
    return _rows(store.write_tree(store.extract(d, chosen), args.output, folders, args.overwrite, args.restore_permissions, needed))


def verify(spark, args):
    bad = _rows(constraints.verify(store.open_dataset(spark, args.dataset), full=not args.quick).limit(100))
    return {"valid": not bad, "mode": "quick" if args.quick else "full", "errors": bad}


def verify_deterministic(spark, args):
    """Whether two datasets hold the same tables."""
    digests = [store.dataset_digest(store.open_dataset(spark, path)) for path in (args.first, args.second)]
    return {"valid": digests[0] == digests[1], "digests": digests}


def migrate(spark, args):
    migration.migrate(spark, args.source, args.dataset, args.overwrite)
    return migration.compatibility(spark, args.dataset)


def benchmark(spark, args):
    contents, _, _ = _read(spark, args)
    rows = measure.benchmark(contents, args.profile, args.repeats)
    text = measure.markdown(rows)
    if args.markdown:
        with open(args.markdown, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    return {"rows": rows, "markdown": text}


def doctor(spark, args=None):
    """Versions and self-tests."""
    probe = b"self-test " * 64
    sound = {name: codecs.unpack_bytes(name, codecs.pack_bytes(name, probe), len(probe)) == probe for name in codecs.CODECS}
    with tempfile.NamedTemporaryFile() as f:
        f.write(b"x")
        f.flush()
        writable = os.path.getsize(f.name) == 1
    files = spark.createDataFrame([("a.txt", bytearray(probe)), ("b.txt", bytearray(probe))], "path string, content binary")
    same = len({store.dataset_digest(store.pack(files)) for _ in range(2)}) == 1
    return {"engine": store.ENGINE, "python": platform.python_version(), "spark": spark.version, "codecs": sound, "temporary_folder": writable, "deterministic": same, "valid": all(sound.values()) and writable and same}


COMMANDS: dict[str, Callable] = {
    "pack": pack, "unpack": unpack, "extract": unpack, "verify": verify, "verify-deterministic": verify_deterministic, "migrate": migrate, "benchmark": benchmark, "doctor": doctor,
    "list": lambda spark, args: _rows(store.list_files(store.open_dataset(spark, args.dataset)).orderBy("path")),
    "inspect": lambda spark, args: _rows(store.inspect_dataset(store.open_dataset(spark, args.dataset)))[0],
    "explain": lambda spark, args: [r["text"] for r in store.explain(store.open_dataset(spark, args.dataset)).orderBy("path").toLocalIterator()],
    "compatibility": lambda spark, args: migration.compatibility(spark, args.dataset),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quern", description="Content-addressed datasets on Spark.")
    commands = out.add_subparsers(dest="command", required=True)

    def add(name: str, *operands: str, packing: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for o in operands:
            p.add_argument(o, nargs="+" if o in ("inputs", "paths") else None)
        p.add_argument("--json", action="store_true")
        if packing:
            p.add_argument("--profile", choices=store.PROFILES, default="general")
            p.add_argument("--goal", choices=codecs.GOALS, default="balanced")
            p.add_argument("--chunk-size", type=size, default=chunking.DEFAULT_CHUNK)
            p.add_argument("--codec", choices=sorted(codecs.CODECS))
            p.add_argument("--level", type=int)
            p.add_argument("--exclude", action="append", default=[])
            p.add_argument("--include", action="append", default=[])
            p.add_argument("--include-all", action="store_true")
            p.add_argument("--follow-symlinks", action="store_true")
            p.add_argument("--store-permissions", action="store_true")
            p.add_argument("--telemetry-mode", choices=("exact", "canonical"), default="exact")
            p.add_argument("--time-field")
        return p

    add("pack", "inputs", packing=True).add_argument("-o", "--dataset", required=True)
    commands.choices["pack"].add_argument("--overwrite", action="store_true")
    for name, operands in (("unpack", ["dataset"]), ("extract", ["dataset", "paths"])):
        p = add(name, *operands)
        p.add_argument("-o", "--output", required=True)
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--restore-permissions", action="store_true")
        p.add_argument("--no-verify", dest="verify", action="store_false")
        p.add_argument("--max-files", type=int, default=1_000_000)
        p.add_argument("--max-chunks", type=int, default=10_000_000)
        p.add_argument("--max-extract-size", type=size, default=1 << 50)
    for name in ("list", "inspect", "explain", "compatibility"):
        add(name, "dataset")
    add("verify", "dataset").add_argument("--quick", action="store_true")
    add("verify-deterministic", "first", "second")
    add("migrate", "source", "dataset").add_argument("--overwrite", action="store_true")
    add("benchmark", "inputs", packing=True).add_argument("--repeats", type=int, default=3)
    commands.choices["benchmark"].add_argument("--markdown", metavar="FILE")
    add("doctor")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        result = COMMANDS[args.command](_session(), args)
    except Exception as e:  # the exit code tells, the message says what
        print(f"quern: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        return 2
    if args.json or isinstance(result, dict):
        print(json.dumps(result, indent=2, sort_keys=True, default=str))
    else:
        print("\n\n".join(r if isinstance(r, str) else "  ".join(f"{k}={v}" for k, v in r.items()) for r in result))
    return 0 if not isinstance(result, dict) or result.get("valid", True) else 2
