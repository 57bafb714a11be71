"""python -m lattica.cli tau|alpha|slice|pack ...: measures of volumes as CSV."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators.reshape import aspect_size, clamp_crop, crop, random_crop
from .operators.surface import mesh
from .plans import actions
from .sources import files
from .volumes import Dims, parse_directions, to_bricks, to_voxels


def dims(text: str) -> Dims:
    """"x" or "x,y,z"."""
    parts = [int(p) for p in text.split(",")]
    return tuple(parts * 3 if len(parts) == 1 else parts)


def numbers(text: str) -> tuple[float, float, float]:
    parts = [float(p) for p in text.split(",")]
    return tuple(parts * 3 if len(parts) == 1 else parts)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lattica")
    actions_ = out.add_subparsers(dest="action", required=True)
    one = {name: actions_.add_parser(name) for name in ("tau", "alpha", "slice", "pack")}
    for name in ("tau", "alpha", "slice"):
        one[name].add_argument("input")
        one[name].add_argument("--sub", type=dims)
        one[name].add_argument("--origin", type=dims, default=(0, 0, 0))
        one[name].add_argument("--randsub", type=dims)
        one[name].add_argument("--aspect", type=numbers, default=(1.0, 1.0, 1.0))
        one[name].add_argument("--seed", type=int, default=0)
    for p in one.values():
        p.add_argument("-o", "--output")
    for name in ("tau", "alpha"):
        one[name].add_argument("-d", "--dir", default="x-")
    one["tau"].add_argument("--tol", type=float, default=6)
    one["tau"].add_argument("--iter", type=int, default=10000)
    one["tau"].add_argument("--over", "--oversubscribe", action="store_true")
    one["tau"].add_argument("-p", "--precision", default="double")
    one["tau"].add_argument("--solver", default="CG")
    one["tau"].add_argument("-v", "--verbose", action="store_true")
    one["alpha"].add_argument("--basic", action="store_true")
    one["alpha"].add_argument("--mesh")
    one["alpha"].add_argument("--segmentinfo")
    one["slice"].add_argument("--size", type=dims, default=(32, 32, 32))
    one["slice"].add_argument("--stride", type=dims, default=(1, 1, 1))
    one["slice"].add_argument("--begin", type=dims, default=(0, 0, 0))
    one["slice"].add_argument("--end", type=dims)
    one["slice"].add_argument("--out", default="out")
    one["pack"].add_argument("--targetEps", type=float)
    one["pack"].add_argument("--targetTolerance", type=float, default=0.03)
    one["pack"].add_argument("-N", "-n", type=int, default=8)
    one["pack"].add_argument("-s", "--size", type=numbers, default=(0.5, 0.5, 0.5))
    one["pack"].add_argument("--rasterOutput")
    one["pack"].add_argument("--sdfOutput")
    one["pack"].add_argument("--maxIter", type=int, default=2000)
    one["pack"].add_argument("--schedule", type=float, default=0.99)
    one["pack"].add_argument("--raster", type=int, default=256)
    return out


def load(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The input's bricks, cropped as asked."""
    bricks = files.read_volume(spark, args.input, args.sub)
    kind = files.extension(args.input)
    whole = tuple(bricks.select("dx", "dy", "dz").first())
    low, size = (0, 0, 0), whole
    if args.sub and kind not in ("pos", "sph"):
        low, size = clamp_crop(whole, args.origin, args.sub)
    if args.aspect != (1.0, 1.0, 1.0):
        size = aspect_size(size, args.aspect)
    if args.randsub:
        return to_bricks(random_crop(to_voxels(bricks), whole, args.randsub, args.seed), args.randsub)
    return bricks if size == whole else to_bricks(crop(to_voxels(bricks), low, size), size)


def emit(rows: DataFrame, target: str | None) -> None:
    if target:
        files.write_results(rows, target)
        return
    names = sorted(rows.columns)
    print(",".join(names))
    for row in rows.select(*names).toLocalIterator():
        print(",".join(str(int(v)) if isinstance(v, bool) else str(v) for v in row))


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as end:
        return actions.FAILED if end.code else actions.DONE
    spark = spark or SparkSession.builder.appName("lattica").getOrCreate()
    try:
        if args.action == "pack":
            made = actions.pack(spark, args.N, args.size, args.targetEps, args.targetTolerance, args.maxIter, args.schedule, args.raster if args.rasterOutput else 0)
            if args.sdfOutput:
                files.write_primitives(made.particles, args.sdfOutput)
            if args.rasterOutput:
                files.write_bin(actions.sdf.rasterize_sets(made.particles, (args.raster,) * 3), args.rasterOutput)
            emit(made.rows, args.output)
            return made.code
        bricks = load(spark, args)
        if args.action == "tau":
            emit(actions.tau(bricks, parse_directions(args.dir), args.solver, 10.0**-args.tol, args.iter, args.precision, oversubscribe=args.over), args.output)
        elif args.action == "alpha":
            if args.mesh:
                whole = tuple(bricks.select("dx", "dy", "dz").first())
                files.write_obj(*mesh(padded(to_voxels(bricks), whole), tuple(d + 2 for d in whole)), args.mesh, by_volume=False)
            if args.segmentinfo:
                files.write_results(actions.unreachable_segments(bricks), args.segmentinfo)
            emit(actions.alpha_basic(bricks) if args.basic else actions.alpha(bricks, parse_directions(args.dir), bool(args.segmentinfo)), args.output)
        else:
            found = actions.slices(bricks, args.size, args.stride, begin=args.begin, end=args.end)
            files.write_results(found, args.output or f"{args.out}/data.csv")
            cut = actions.cut_windows(bricks, args.size, args.stride, args.begin, args.end)
            name = actions.F.format_string("%04d_%04d_%04d.bin", "originx", "originy", "originz")
            files.write_files(files.encode_bin(cut), args.out, name)
        return actions.DONE
    except (ValueError, FileNotFoundError) as wrong:
        print(wrong, file=sys.stderr)
        return actions.FAILED


def padded(vox: DataFrame, whole: Dims) -> DataFrame:
    from .operators.reshape import pad

    return pad(vox, whole, (1, 1, 1), (1, 1, 1))




if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
