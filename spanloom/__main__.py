"""Command line: ``python -m spanloom call | genotype | cluster | compare``."""

from __future__ import annotations

import argparse
import dataclasses
from collections.abc import Sequence


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("a number from 1 on")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom", description="Structural variants from alignments, with Spark.")
    commands = p.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--seed", type=int, default=0, help="seed of random sampling")
    shared.add_argument("--max-seq-error", type=float, default=0.04, help="largest share of sequencing errors")
    shared.add_argument("--min-sv-size", type=positive, default=50, help="smallest variant")
    shared.add_argument("--min-clip-len", type=int, default=10, help="shortest clip that counts")
    shared.add_argument("--min-diff-hsr", type=int, default=2, help="differences that make a read a hidden split read")
    shared.add_argument("--coverage-window-size", type=positive, default=1000, help="width of the coarse depth windows")
    shared.add_argument("--sampling-regions", help="BED of regions to take statistics from")
    shared.add_argument("--min-stable-mapq", type=int, default=20, help="least quality of a stable read")
    shared.add_argument("--high-confidence-mapq", type=int, default=60, help="quality from which a read is sure")
    shared.add_argument("--per-contig-stats", action="store_true", help="depth statistics by contig")
    shared.add_argument("--single-pass", action="store_true", help="one pass of genotyping")
    shared.add_argument("--write-aux-snp", action="store_true", help="write companion single bases")
    shared.add_argument("--haploid-contigs", default="", help="contigs, by commas, that are haploid")
    shared.add_argument("--samplename", default="", help="name of the sample column")
    for name, text in (("call", "find and genotype variants"), ("genotype", "genotype given variants")):
        c = commands.add_parser(name, parents=[shared], help=text)
        if name == "genotype":
            c.add_argument("in_vcf", help="variants")
        else:
            c.add_argument("--max-trans-size", type=positive, default=10_000, help="largest distance of two consensuses of one variant")
        c.add_argument("reads", help="alignments as Parquet, partitioned by contig")
        c.add_argument("reference", help="FASTA")
        c.add_argument("out", help="folder for the result")
    c = commands.add_parser("compare", help="match two call sets")
    c.add_argument("benchmark")
    c.add_argument("called")
    c.add_argument("out")
    c.add_argument("--tr-bed", help="BED of tandem repeats")
    c = commands.add_parser("cluster", help="cluster calls of a cohort")
    c.add_argument("list", help="lines of sample and path")
    c.add_argument("out")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from .plans import drivers, variants
    from .session import session
    from .sources import readers, vcf, writers

    spark = session()
    if args.command in ("call", "genotype"):
        names = {f.name for f in dataclasses.fields(drivers.Config)}
        config = drivers.Config(**{k: v for k, v in vars(args).items() if k in names})
        reads, contigs = readers.reads(spark, args.reads), readers.fasta(spark, args.reference)
        if args.sampling_regions:
            config = drivers.measured(readers.reads_in_regions(reads, readers.sampling_regions(spark, args.sampling_regions)), config)
        calls = vcf.read_vcf(spark, args.in_vcf) if args.command == "genotype" else None
        if calls is not None:
            calls = variants.sets.require_unique(calls, ["id"])
        head, lines = drivers.as_vcf(drivers.run(spark, args.command, reads, contigs, config, calls), contigs, args.samplename or "sample")
        writers.vcf(lines, head, args.out)
    elif args.command == "compare":
        b, c = vcf.read_vcf(spark, args.benchmark), vcf.read_vcf(spark, args.called)
        repeats = readers.bed(spark, args.tr_bed).withColumnRenamed("contig", "chr") if args.tr_bed else None
        writers.table(variants.compare(b, c, repeats=repeats), args.out)
    else:
        samples = sorted(s for s, _ in readers.file_list(spark, args.list))
        writers.table(variants.cohort(readers.variants_of_files(spark, args.list), samples), args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
