"""Command line: `python -m strandloom.cli pileup ...`, `... cluster ...` and `... convert ...`."""

from __future__ import annotations

import argparse
import os

from .functions.codecs import CHROMOSOMES
from .operators import variants
from .operators.divide import Settings, divide
from .session import build_session
from .sources import alignments, genome, lists, pileup, vcf
from .sources.files import put


def chromosomes(text: str) -> list[str]:
    names = [x.strip().upper() for x in text.split(",") if x.strip()]
    if wrong := [x for x in names if x not in CHROMOSOMES]:
        raise argparse.ArgumentTypeError(f"no such chromosome: {', '.join(wrong)}")
    return names


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("pileup", help="alignments to pileups")
    c = sub.add_parser("cluster", help="pileups to clusters and variants")
    t = sub.add_parser("convert", help="text pileups to binary ones")
    for x in (p, c, t):
        x.add_argument("-i", required=True, help="input files or folder")
        x.add_argument("-o", required=True, help="output folder")
        x.add_argument("--num_threads", default="*")
    for x in (p, c):
        x.add_argument("--chromosomes", type=chromosomes, default=CHROMOSOMES[:23])
        x.add_argument("--max_coverage", type=int, default=100)
    for name, value in (("min_base_quality", 30), ("min_map_quality", 30), ("min_map_score", 0), ("min_different", 3)):
        p.add_argument(f"--{name}", type=int, default=value)
    p.add_argument("--format", choices=("bin", "txt", "parquet"), default="bin")
    p.add_argument("--read_names", action="store_true", help="write the names of reads with their ids")
    for name, value in (("seq_error_rate", 0.01), ("mutation_rate", 0.01), ("homozygous_filtered_rate", 0.5), ("heterozygous_prob", 1e-3)):
        c.add_argument(f"--{name}", type=float, default=value)
    for name, value in (("merge_count", 1), ("min_cluster_size", 100), ("max_cell_count", 10_000)):
        c.add_argument(f"--{name}", type=int, default=value)
    c.add_argument("--tumor_purity", type=int, choices=range(1, 6), default=5)
    for name, allowed in (("clustering_type", ("SPECTRAL6", "SPECTRAL2", "FIEDLER")), ("termination", ("BIC", "AIC")), ("normalization", ("ADD_MIN", "EXPONENTIATE", "SCALE_MAX_1"))):
        c.add_argument(f"--{name}", choices=allowed, default=allowed[0])
    for name in ("merge_file", "reference_genome", "map_file", "pos_file", "clustering"):
        c.add_argument(f"--{name}", default="")
    for name in ("expectation_maximization", "arma_kmeans", "compute_read_stats", "all_matrices"):
        c.add_argument(f"--{name}", action="store_true")
    return top


def run_pileup(spark, a) -> None:
    files = sorted(f for part in a.i.split(",") for f in pileup.file_names(spark, part)[1] if f.endswith((".bam", ".sam")))
    if not files:
        raise SystemExit(f"no alignments in {a.i}")
    reads = alignments.read_alignments(spark, files, a.chromosomes)
    obs = alignments.build_pileup(reads, a.min_different, a.max_coverage, a.min_base_quality, a.min_map_quality, a.min_map_score)
    if a.format == "parquet":
        pileup.write_parquet(obs, os.path.join(a.o, "pileup.parquet"))
    elif a.format == "txt":
        pileup.write_text(obs, os.path.join(a.o, "pileup.txt"))
    else:
        pileup.write_binary(obs, a.o)
    if a.read_names:
        pileup.write_read_names(pileup.read_dictionary(reads, obs, a.format == "bin"), os.path.join(a.o, "read_names.map"))
    put(os.path.join(a.o, "cells.map"), "".join(f"{alignments.cell_name(p)}\t{i}\n" for i, p in enumerate(files)))


def run_convert(spark, a) -> None:
    pileup.convert_text(spark, pileup.discover(spark, a.i)[1], a.o)


def run_cluster(spark, a) -> None:
    groups = lists.cell_grouping(spark, a.merge_count, a.merge_file or None, a.max_cell_count)
    listed = lists.read_positions(spark, a.pos_file) if a.pos_file else None
    obs = pileup.read_pileup(spark, a.i, a.max_coverage, listed, groups, chromosomes=a.chromosomes).persist()
    if a.compute_read_stats:
        print(pileup.statistics(obs).first().asDict())
    if a.clustering:
        labels = lists.group_labels(lists.read_clustering(spark, a.clustering), groups)
    else:
        measured = a.compute_read_stats or pileup.discover(spark, a.i)[0] == "txt"  # fragments are then as long as they are
        settings = Settings(
            a.seq_error_rate, a.mutation_rate, a.homozygous_filtered_rate, a.tumor_purity - 1, a.normalization, a.clustering_type, a.termination, a.min_cluster_size, a.expectation_maximization,
            max_cells=a.max_cell_count, plain_kmeans=a.arma_kmeans, max_fragment=0 if measured else Settings.max_fragment,
        )
        labels = divide(obs, settings, lambda level: lists.write_level(level, a.o, a.all_matrices))
        lists.write_clustering(lists.spread_groups(labels, groups), os.path.join(a.o, "clustering"))
    if a.reference_genome:
        reference = genome.reference_genotypes(spark, a.reference_genome, obs, a.map_file or None)
        own, common, calls = variants.variant_table(obs, labels, reference, a.seq_error_rate, a.heterozygous_prob)
        clusters = sorted(r[0] for r in labels.select("cluster_id").distinct().collect())
        vcf.write_clusters(own, common, a.o, a.reference_genome, clusters)
        variants.cell_scores(obs, labels, calls).orderBy("cell_id").write.mode("overwrite").csv(os.path.join(a.o, "scores"))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = build_session(a.num_threads)
    {"pileup": run_pileup, "cluster": run_cluster, "convert": run_convert}[a.command](spark, a)


if __name__ == "__main__":
    main()
