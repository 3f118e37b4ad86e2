"""Reference genomes in FASTA, haploid or diploid, with maps of insertions and deletions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import chromosome_id, encode_base, genotype
from ..session import with_checkpoints

CHUNK = 10_000


def read_bases(spark: SparkSession, path: str) -> DataFrame:
    """(_path, _block, _segment, _name, _at, _piece): the bases of a genome, in pieces of about CHUNK, and its headers.

    Spark cuts files into ranges of bytes (blocks); each task counts bases from its block's start, or from the last header in
    it, whichever is later: that is a segment, the first of a block being number 0. No more than a piece is ever held, but a
    sequence that is a single line is a single piece.
    """
    names = ["_path", "_block", "_segment", "_name", "_at", "_piece"]

    def run(batches):
        block, segment, at, held, size, rows = None, 0, 0, [], 0, []

        def flush():
            nonlocal at, held, size
            if size:
                rows.append((*block, segment, None, at, "".join(held)))
                at, held, size = at + size, [], 0

        def pack():
            columns = list(zip(*rows))
            rows.clear()
            types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for here, line in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                if here != block:
                    flush()
                    block, segment, at = here, 0, 0
                if line.startswith(">"):
                    flush()
                    segment, at = segment + 1, 0
                    rows.append((*block, segment, next(iter(line[1:].split()), ""), 0, None))
                else:
                    bases = "".join(line.split())
                    held.append(bases)
                    size += len(bases)
                    if size >= CHUNK:
                        flush()
            if len(rows) >= 200:
                yield pack()
        flush()
        if rows:
            yield pack()

    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")
    return lines.mapInArrow(run, "_path string, _block bigint, _segment int, _name string, _at bigint, _piece string")


def read_genome(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Contigs (nr, contig, _n), in order of the file and with their lengths, and pieces (nr, contig, start, piece).

    start counts from 0 within the contig. A folder is read as its files in order of their names, one behind the other. The
    pieces are checkpointed: lengths are summed, and loci joined, of one pass. Only segments, a row a block and a header, are
    put in order in one place.
    """
    bases = read_bases(with_checkpoints(spark), path).checkpoint()
    segment = ["_path", "_block", "_segment"]
    sizes = bases.groupBy(*segment).agg(F.max("_name").alias("_name"), F.sum(F.coalesce(F.length("_piece"), F.lit(0))).cast("bigint").alias("_n"))
    in_order = Window.orderBy(*segment)
    numbered = sizes.withColumn("nr", F.sum(F.when(F.col("_name").isNotNull(), 1).otherwise(0)).over(in_order)).where("nr > 0")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("nr").orderBy(*segment).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = numbered.withColumns({"_offset": before, "contig": F.max("_name").over(Window.partitionBy("nr"))})
    contigs = numbered.groupBy("nr").agg(F.max("contig").alias("contig"), F.sum("_n").alias("_n"))
    pieces = bases.where("_piece is not null").join(numbered.select(*segment, "nr", "contig", "_offset"), segment)
    return contigs, pieces.select("nr", "contig", (F.col("_offset") + F.col("_at")).alias("start"), F.col("_piece").alias("piece"))


def is_diploid(contigs: DataFrame) -> bool:
    first = contigs.orderBy("nr").select("contig").first()
    return bool(first) and "maternal" in first[0]


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(contig, nr, start_pos, len, tr), in order of the file: nr is the event's place, start_pos counts from 0.

    Lines have 8 columns, others are an error; comments and SEQ rows are left out, INS is I, anything else D.
    """
    f = F.split("value", "\t")
    rows = spark.read.text(path).withColumn("nr", F.monotonically_increasing_id()).where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))
    checked = F.when(F.size(f) == 8, f).otherwise(F.raise_error(F.concat(F.lit("8 columns expected: "), F.col("value"))).cast("array<string>"))
    rows = rows.select("nr", checked.alias("f")).where(F.col("f")[6] != "SEQ")
    return rows.select(F.col("f")[1].alias("contig"), "nr", (F.col("f")[2].cast("bigint") - 1).alias("start_pos"), F.col("f")[0].cast("bigint").alias("len"), F.when(F.col("f")[6] == "INS", "I").otherwise("D").alias("tr"))


def offsets(events: DataFrame) -> DataFrame:
    """What each event (contig, nr, start_pos, len, tr) makes of the coordinates: _out, _gap, _host, _drop.

    From place _out of the reference on there are _gap unknown bases (of a deletion), then the contig goes on at its own
    place _host. An event moves the place in the contig up to its start, if it isn't there yet, and an insertion's length
    farther: a running maximum of starts less the lengths before.
    """
    by = Window.partitionBy("contig").orderBy("nr").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumns({"_i": F.when(F.col("tr") == "I", F.col("len")).otherwise(0), "_d": F.when(F.col("tr") == "D", F.col("len")).otherwise(0)})
    events = events.withColumns({"_in": F.sum("_i").over(by), "_drop": F.sum("_d").over(by)})
    events = events.withColumn("_copied", F.greatest(F.lit(0), F.max(F.col("start_pos") - F.col("_in") + F.col("_i")).over(by)))
    return events.select("contig", "nr", (F.col("_copied") + F.col("_drop") - F.col("_d")).alias("_out"), F.col("_d").alias("_gap"), (F.col("_copied") + F.col("_in")).alias("_host"), "_drop")


def segments(contigs: DataFrame, events: DataFrame) -> DataFrame:
    """(contig, _from, _to, _host): places _from to before _to of the reference are those of the contig from _host on.

    contigs: (contig, _n) with lengths. Places in no segment are unknown.
    """
    start = contigs.select("contig", F.lit(-1).cast("bigint").alias("nr"), *(F.lit(0).cast("bigint").alias(c) for c in ("_out", "_gap", "_host", "_drop")))
    all_ = start.unionByName(offsets(events)).join(contigs.select("contig", "_n"), "contig")
    own = Window.partitionBy("contig").orderBy("nr")
    begin = F.col("_out") + F.col("_gap")
    upto = F.coalesce(F.lead("_out").over(own), begin + F.greatest(F.lit(0), F.col("_n") - F.col("_host")))
    return all_.select("contig", begin.alias("_from"), upto.alias("_to"), "_host").where("_to > _from")


def mapped_lengths(contigs: DataFrame, events: DataFrame) -> DataFrame:
    """(contig, _length): lengths of (contig, _n) in reference coordinates."""
    last = offsets(events).groupBy("contig").agg(F.max_by(F.struct("_out", "_gap", "_host"), "nr").alias("e"))
    rest = F.greatest(F.lit(0), F.col("_n") - F.coalesce("e._host", F.lit(0)))
    return contigs.join(last, "contig", "left").select("contig", (F.coalesce(F.col("e._out") + F.col("e._gap"), F.lit(0)) + rest).alias("_length"))


def host_places(loci: DataFrame, segments_: DataFrame, size: int = CHUNK) -> DataFrame:
    """loci (contig, _at) with _host, the place in the contig; null where the reference has a gap.

    An interval join: segments are dealt to the stretches of `size` places that they touch, so that it is an equi-join.
    """
    dealt = segments_.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor((F.col("_to") - 1) / size))))
    found = loci.withColumn("_chunk", F.floor(F.col("_at") / size)).join(dealt, ["contig", "_chunk"]).where("_at >= _from AND _at < _to")
    found = found.select("contig", "_at", (F.col("_host") + F.col("_at") - F.col("_from")).alias("_host")).distinct()
    return loci.join(found, ["contig", "_at"], "left")


def letters_at(places: DataFrame, pieces: DataFrame, size: int = CHUNK) -> DataFrame:
    """places (nr, _host, ...) that lie in a piece, with its letter there: letter.

    An interval join: pieces are dealt to the stretches of `size` places that they touch, so that it is an equi-join.
    """
    stretches = F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.length("piece") - 1) / size))
    dealt = pieces.select("nr", "start", "piece", F.explode(stretches).alias("_chunk"))
    found = places.withColumn("_chunk", F.floor(F.col("_host") / size)).join(dealt, ["nr", "_chunk"]).where("_host >= start AND _host < start + length(piece)")
    return found.select(*places.columns, F.col("piece").substr((F.col("_host") - F.col("start") + 1).cast("int"), F.lit(1)).alias("letter"))


def reference_genotypes(spark: SparkSession, path: str, loci: DataFrame, map_path: str | None = None) -> DataFrame:
    """(chromosome_id, position, reference) of the loci inside the genome.

    Contigs are matched by name. A diploid genome has a maternal contig and then the paternal one; a contig alone (Y, or X
    of a male) counts for both alleles. Paired contigs of different length are an error. With a map the loci are places of
    the reference that the contigs come from; they are moved to the contigs, no sequence is rewritten.
    """
    contigs, pieces = read_genome(spark, path)
    plain = F.regexp_replace(F.regexp_replace("contig", "^chr", ""), "_(maternal|paternal)$", "")
    named = contigs.withColumn("chromosome_id", chromosome_id(plain)).where("chromosome_id is not null")
    side = Window.partitionBy("chromosome_id").orderBy("nr")  # two contigs
    names = named.withColumn("_side", F.row_number().over(side)).select("chromosome_id", "contig", "_side", "_n", F.col("nr").alias("_nr")).checkpoint()  # 48 rows at most
    events = read_map(spark, map_path) if map_path else spark.createDataFrame([], "contig string, nr bigint, start_pos bigint, len bigint, tr string")
    sizes = names.join(mapped_lengths(names, events), "contig").groupBy("chromosome_id").agg(F.min("_length").alias("a"), F.max("_length").alias("b"))
    if not sizes.where("a <> b").isEmpty():
        raise ValueError("paired contigs of different length")
    wanted = loci.select("chromosome_id", "position").distinct()
    spots = wanted.join(F.broadcast(names), "chromosome_id").join(F.broadcast(mapped_lengths(names, events)), "contig").where("position >= 1 AND position <= _length")  # 48 contigs at most
    spots = spots.select("chromosome_id", "position", "contig", "_side", F.col("_nr").alias("nr"), (F.col("position") - 1).alias("_at"))
    places = host_places(spots, segments(names, events)) if map_path else spots.withColumn("_host", F.col("_at"))
    letters = letters_at(places.where("_host IS NOT NULL"), pieces).select("chromosome_id", "position", "_side", F.col("letter").alias("_b"))
    if map_path:
        letters = letters.unionAll(places.where("_host IS NULL").select("chromosome_id", "position", "_side", F.lit("N")))
    two = letters.groupBy("chromosome_id", "position").agg(F.max(F.when(F.col("_side") == 1, F.col("_b"))).alias("_m"), F.max(F.when(F.col("_side") == 2, F.col("_b"))).alias("_p"))
    return two.select("chromosome_id", "position", genotype(encode_base(F.col("_m")), encode_base(F.coalesce("_p", "_m"))).alias("reference"))
