"""Command line: enlarge image files or fuse a burst.

    spark-submit gridloom/cli.py upscale FOLDER SCALE OUT
    spark-submit gridloom/cli.py burst OUT SCALE FRAME...
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.plans.upscale import dispatched, fuse_burst
from gridloom.sources import images


def export_name(path: str, scale: int, form: str = "ppm") -> str:
    """<stem>-<scale>x.<form> of an image's path."""
    return f"{os.path.splitext(os.path.basename(path))[0]}-{scale}x.{form}"


def main(args: list[str]) -> int:
    if len(args) < 4 or args[0] not in ("upscale", "burst"):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    scale = int(args[2])
    named = F.concat(F.regexp_replace(F.element_at(F.split("image_id", "/"), -1), r"\.[^.]*$", ""), F.lit(f"-{scale}x.ppm"))
    if args[0] == "upscale":
        done, tiles = dispatched(images.read(spark, args[1]), scale)
        images.write(done.withColumn("image_id", named), args[3])
        if scale != 8:
            images.write_tiles(tiles.withColumn("image_id", named), args[3], scale)
    else:
        frames = None
        for k, path in enumerate(args[3:]):
            one = images.read(spark, path).select(F.lit(args[1]).alias("burst_id"), F.lit(k).alias("frame"), "c", "w", "h", "v")
            frames = one if frames is None else frames.unionByName(one)
        done = fuse_burst(frames, scale).withColumnRenamed("burst_id", "image_id")
        images.write(done.withColumn("image_id", named), os.path.dirname(args[1]) or ".")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
