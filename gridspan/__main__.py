"""Commands: ls, info, dump, convert, copy, consolidate, manifest, validate, pyramid."""

from __future__ import annotations

import argparse
import json
import sys


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("gridspan").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def opened(spark, path: str, node: str):
    from .sources import h5, stores, zarr

    if stores.sniff(path) == "hdf5":
        return h5.read_dataset(spark, path, node)
    return zarr.read_array(spark, path, node)


def run(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="gridspan", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("ls", "info", "manifest", "consolidate", "validate", "dump", "pyramid"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("node", nargs="?", default="")
        if name == "ls":
            p.add_argument("-r", dest="recursive", action="store_true")
        if name == "dump":
            p.add_argument("--slice", default="")
            p.add_argument("--form", default="text", choices=["text", "csv", "json"])
        if name == "validate":
            p.add_argument("--strict", action="store_true")
            p.add_argument("--metadata-only", action="store_true")
            p.add_argument("--json", action="store_true")
        if name == "pyramid":
            p.add_argument("target")
            p.add_argument("--axes", required=True)
            p.add_argument("--factors", required=True)
            p.add_argument("--method", default="mean", choices=["mean", "mode", "nearest"])
            p.add_argument("--kind", default="float", choices=["float", "int", "wide", "bool"])
            p.add_argument("--type", dest="data_type", required=True)
            p.add_argument("--chunks", required=True)
            p.add_argument("--levels", type=int)
    for name in ("convert", "copy"):
        p = sub.add_parser(name)
        p.add_argument("source")
        p.add_argument("target")
        p.add_argument("--array", default="")
        p.add_argument("--chunks")
    a = parser.parse_args(argv)
    numbers = lambda s: tuple(map(int, s.split(",")))
    from .plans import catalog, convert, images, validate
    from .sources import h5, stores

    if a.command == "ls":
        if stores.sniff(a.path) == "hdf5":
            from .sources.h5format import H5File

            print(*[f"{kind:8} {path}" for path, kind, _ in H5File(a.path).nodes() if path != "/" and (a.recursive or path.count("/") == 1)], sep="\n")
        else:
            print(*catalog.ls(a.path, a.recursive), sep="\n")
    elif a.command == "consolidate":
        print(catalog.consolidate(a.path))
    elif a.command in ("info", "manifest"):
        spark = session()
        parts = h5.catalog(spark, a.path) if stores.sniff(a.path) == "hdf5" else {"nodes": catalog.nodes(spark, a.path)}
        for name, df in parts.items():
            if a.command == "info" and "path" in df.columns and a.node:
                df = df.filter(df.path == a.node)
            for line in df.toJSON().collect():
                print(name, line)
    elif a.command == "validate":
        spark = session()
        issues = validate.validate(spark, a.path, a.metadata_only).cache()
        for r in issues.orderBy("node", "pointer").collect():
            print(json.dumps(r.asDict()) if a.json else f"{r.severity} {r.node} {r.pointer}: {r.message}")
        return int(not validate.tally(issues, a.strict)["valid"])
    elif a.command == "dump":
        from .functions.text import dump_lines
        from .operators.selection import slice_text

        part = slice_text(opened(session(), a.path, a.node), a.slice)
        for r in dump_lines(part, a.form).toLocalIterator():
            print(r["line"])
    elif a.command == "pyramid":
        image = opened(session(), a.path, a.node)
        for shape in images.write_pyramid(image, a.target, axes=a.axes, factors=numbers(a.factors), method=a.method, kind=a.kind, data_type=a.data_type, chunks=numbers(a.chunks), levels=a.levels):
            print(shape)
    elif a.command == "convert":
        spark = session()
        if stores.sniff(a.source) == "hdf5":
            print(*convert.h5_to_zarr(spark, a.source, a.target), sep="\n", file=sys.stderr)
        else:
            convert.zarr_to_h5(spark, a.source, a.array, a.target, a.array or "data")
    elif a.command == "copy":
        spark = session()
        if a.chunks:
            convert.copy_array(spark, a.source, a.array, a.target, a.array, chunks=numbers(a.chunks))
        else:
            print(convert.copy_keys(spark, a.source, a.target))
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
