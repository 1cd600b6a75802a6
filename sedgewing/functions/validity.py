"""Validity of decoded records: an ordered chain of checks, the first that fails names the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgewing.functions import cigar as C
from sedgewing.functions import flags as G
from sedgewing.functions import names as N

#: The least template length.
LEAST_TLEN = -(1 << 31) + 1


def code(name: Column, flags: Column, pos: Column, next_pos: Column, tlen: Column, cigar: Column, seq_length: Column, qualities: Column | None = None, ref_id: Column | None = None, n_refs: int | None = None) -> Column:
    """Null for a valid record. ``qualities`` is an array of numbers; with ``n_refs`` the reference must be one of the header's."""
    annotation = G.has(flags, "QCFAIL") & G.has(flags, "SECONDARY")
    checked = ~G.has(flags, "UNMAP") & ~annotation & (seq_length > 0)
    out = F.when(F.length(name) == 0, "queryname_empty").when(~N.valid(name), "queryname_contains_illegal_symbols")
    out = out.when(F.exists(cigar, lambda x: ~x["op"].isin(*"MIDNSHP=X")), "unknown_cigar_op")
    out = out.when(checked & (C.read_length(cigar) != seq_length), "cigar_is_inconsistent_with_sequence_length")
    out = out.when(pos < -1, "invalid_mapping_position").when(next_pos < -1, "invalid_next_mapping_position").when(tlen < LEAST_TLEN, "invalid_tlen")
    if qualities is not None:
        out = out.when(F.exists(qualities, lambda q: q > 93) & ~F.forall(qualities, lambda q: q == 255), "invalid_quality_value")
    if ref_id is not None and n_refs is not None:
        out = out.when((ref_id < -1) | (ref_id >= n_refs), "invalid_reference")
    return out
