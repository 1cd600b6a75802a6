"""Sequences, qualities and k-mers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: IUPAC codes and their complements
IUPAC, COMPLEMENT = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"

#: Windows that are cut from one block of a sequence.
BLOCK = 256


def code(base: Column) -> Column:
    """0 to 3 for A, C, G, T, else 4."""
    at = F.call_function("instr", F.lit("ACGT"), F.upper(base))
    return F.when((at > 0) & (F.length(base) == 1), at - 1).otherwise(F.lit(4))


def complement(seq: Column) -> Column:
    return F.translate(seq, IUPAC, COMPLEMENT)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def qualities(text: Column, offset: int = 33) -> Column:
    """Numbers of a quality string."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def quality_text(numbers: Column, offset: int = 33) -> Column:
    return F.array_join(F.transform(numbers, lambda q: F.char(q + offset)), "")


def base_score(numbers: Column, least: int = 15) -> Column:
    """The sum of the qualities of at least ``least``."""
    return F.aggregate(F.filter(numbers, lambda q: q >= least), F.lit(0).cast("long"), lambda a, q: a + q)


def has_other_bases(seq: Column) -> Column:
    return seq.rlike("[^ACGT]")


def error_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10.0)


def kmers(seq: Column, k: int | Column) -> Column:
    """All windows of k characters; none if the sequence is shorter."""
    last = F.length(seq) - k + 1

    def block(at: Column) -> Column:
        # a place in UTF-8 is found by reading from the start: windows are cut from short blocks
        return F.transform(F.array(F.struct(F.substring(seq, at, F.lit(BLOCK + k - 1)).alias("s"), F.least(F.lit(BLOCK), last - at + 1).alias("n"))), lambda b: F.transform(F.sequence(F.lit(1), b["n"]), lambda i: F.substring(b["s"], i, F.lit(k))))

    blocks = F.when(last >= 1, F.sequence(F.lit(1), last, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.flatten(F.transform(blocks, block)))


def kmer_number(kmer: Column) -> Column:
    """Two bits a base, the first base highest."""
    return F.aggregate(F.filter(F.split(kmer, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a * 4 + code(c))


def clipped(seq: Column, front: Column, back: Column) -> Column:
    """The sequence without its clipped ends."""
    return F.substring(seq, (front + 1).cast("int"), F.greatest(F.length(seq) - front - back, F.lit(0)).cast("int"))


def fastq_text(name: Column, seq: Column, qual: Column, plus: Column | None = None) -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+"), plus if plus is not None else F.lit(""), F.lit("\n"), qual, F.lit("\n"))


def fastq_of_alignment(name: Column, flags: Column, seq: Column, qual: Column) -> Column:
    """FASTQ of an alignment: read number as suffix, reverse strands turned back."""
    reverse = flags.bitwiseAND(16) != 0
    suffix = F.when(flags.bitwiseAND(1) == 0, "").when(flags.bitwiseAND(64) != 0, "/1").when(flags.bitwiseAND(128) != 0, "/2").otherwise("")
    return fastq_text(F.concat(name, suffix), F.when(reverse, reverse_complement(seq)).otherwise(seq), F.when(reverse, F.reverse(qual)).otherwise(qual))


def shreds(seq: Column, length: int, step: int) -> Column:
    """(start, piece): pieces of a fixed length every ``step`` bases."""
    starts = F.when(F.length(seq) >= length, F.sequence(F.lit(0), F.length(seq) - length, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(seq, i + 1, F.lit(length)).alias("piece")))


def segment(bases: Column, start: Column, stop: Column) -> Column:
    """The bases of [start, stop)."""
    return F.substring(bases, (start + 1).cast("int"), (stop - start).cast("int"))


def code_points(text: Column) -> Column:
    """The numbers of a text's characters."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.call_function("ascii", c).cast("long"))


def code_point_sum(text: Column) -> Column:
    return F.aggregate(code_points(text), F.lit(0).cast("long"), lambda s, c: s + c)


def middle_last(kmer: Column, start: int, stop: int) -> Column:
    """The k-mer with its middle part [start, stop) moved behind the rest, as searches by the ends want it."""
    return F.concat(F.substring(kmer, 1, start), F.substring(kmer, F.lit(stop + 1), F.length(kmer)), F.substring(kmer, start + 1, stop - start))


def rank_name(first: Column, second: Column) -> Column:
    """A name of two decimal ranks."""
    return F.concat_ws("_", first.cast("string"), second.cast("string"))


def best_qualities(original: Column, own: Column) -> Column:
    """The qualities from before recalibration where there are any."""
    return F.coalesce(original, own)
