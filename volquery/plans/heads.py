"""The multi-head job: one encoder, several named outputs, bounds by sample and channel, pyramids."""

from __future__ import annotations

import argparse
from dataclasses import MISSING, dataclass, fields
from typing import Any, get_type_hints

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import JobConfig
from ..functions.scalars import sample_id
from ..operators.metadata import pyramid_spec
from ..operators.models import Model, load_model
from ..operators.network import network, repeated
from ..sources.json_files import pyramid_attributes
from ..sources.lookups import read_percentiles, sample_bounds
from ..sources.volumes import ARRAY
from .job import JobResult, build_array_pyramid, build_pyramid, run


@dataclass
class HeadsJob:
    """What the job reads and writes; heads are named in the order of the model's channels."""

    source: str
    percentiles: str
    output: str
    heads: list[str]
    channel: int = 0
    sample: str | None = None
    form: str = "voxels"
    patch: tuple[int, int, int] = (128, 128, 128)
    overlap: int = 16
    block: tuple[int, int, int] = (512, 512, 512)
    min_blend_weight: float = 0.05
    batch_size: int = 32


def sample_of(spark: SparkSession, uri: str) -> str:
    """The first path component after the bucket."""
    return spark.range(1).select(sample_id(F.lit(uri))).first()[0]


def run_heads(spark: SparkSession, job: HeadsJob, model: Model, t_idx: int = 0, c_idx: int = 0, mode: str = "errorifexists") -> tuple[JobResult, dict[str, dict]]:
    """One float32 store per head under ``output/<head>/0`` (an array store where the source is one) and, where the input's group says how, its
    pyramid and attributes.  Outputs hold one plane, so the input's plane must be (0, 0)."""
    if len(job.heads) != model.channels or len(set(job.heads)) != len(job.heads):
        raise ValueError(f"{len(job.heads)} names for {model.channels} heads")
    if (t_idx, c_idx) != (0, 0):
        raise ValueError("outputs hold a single plane: t and c must be 0")
    sample = job.sample or sample_of(spark, job.source)
    low, high = sample_bounds(read_percentiles(spark, job.percentiles), sample, job.channel)
    cfg = JobConfig(
        patch=job.patch, overlap=job.overlap, block=job.block, batch_size=job.batch_size, seam_mode="blend", trim_voxels=None, min_blend_weight=job.min_blend_weight,
        normalize="global", norm_lower=low, norm_upper=high, output_denormalize=False,
    )
    arrays = job.form == "array"
    source = {"driver": ARRAY, "path": job.source} if arrays else {"path": job.source, "form": job.form}
    sinks: list[Any] = [f"{job.output}/{h}/0" for h in job.heads]
    sinks = [{"driver": ARRAY, "path": p, "create": True} for p in sinks] if arrays else sinks
    result = run(spark, source, sinks, cfg, model, dtype="float32", mode=mode)
    attributes = pyramid_attributes(spark, job.source)
    spec = pyramid_spec(attributes) if attributes else None
    written = {}
    for head in job.heads if spec else []:
        root, what = f"{job.output}/{head}", (head, spec["factors"], spec["levels"], spec["voxel"])
        written[head] = build_array_pyramid(spark, root, *what) if arrays else build_pyramid(spark, f"{root}/0", root, *what)
    return result, written


def parse_args(argv: list[str] | None = None) -> tuple[HeadsJob, argparse.Namespace]:
    """The job, and what else the command line says: model, weights and write mode."""
    p = argparse.ArgumentParser(prog="volquery-heads")
    kinds = get_type_hints(HeadsJob)
    for f in fields(HeadsJob):
        how: dict[str, Any] = {"required": True} if f.default is MISSING else {"default": f.default}
        if f.name == "heads":
            how["nargs"] = "+"
        elif isinstance(f.default, tuple):
            how |= {"type": int, "nargs": len(f.default)}
        elif kinds[f.name] in (int, float):
            how["type"] = kinds[f.name]
        p.add_argument("--" + f.name.replace("_", "-"), **how)
    p.add_argument("--model-type", default="identity")
    p.add_argument("--weights", help="of the model, or of the encoder")
    p.add_argument("--head-weights", nargs="+", help="one checkpoint for each head: the model is an encoder and heads")
    p.add_argument("--mode", choices=["errorifexists", "overwrite", "append"], default="errorifexists")
    args = p.parse_args(argv)
    values = {f.name: getattr(args, f.name) for f in fields(HeadsJob)}
    return HeadsJob(**{k: tuple(v) if k in ("patch", "block") else v for k, v in values.items()}), args


def model_of(spark: SparkSession, job: HeadsJob, args: argparse.Namespace) -> Model:
    """An encoder and heads from checkpoints, or a registered model; one of a single channel serves all heads."""
    if args.head_weights:
        if not args.weights or len(args.head_weights) != len(job.heads):
            raise ValueError(f"{len(job.heads)} heads need an encoder's weights and as many of their own")
        return network(spark, args.weights, args.head_weights)
    return repeated(load_model(args.model_type, args.weights, spark), len(job.heads))


def main(argv: list[str] | None = None) -> None:
    job, args = parse_args(argv)
    spark = SparkSession.builder.appName("volquery-heads").getOrCreate()
    run_heads(spark, job, model_of(spark, job, args), mode=args.mode)


if __name__ == "__main__":
    main()
