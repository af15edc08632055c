"""Fixed-length encodings held in array columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SpecialIds:
    """Ids of the marker tokens; the defaults follow the common RoBERTa vocabulary."""

    cls: int = 0
    pad: int = 1
    sep: int = 2
    unk: int = 3
    encoder_only: int = 6


# How many places of the block each layout keeps for markers.
LAYOUT_MARKERS = {"plain": 2, "encoder_only": 4}

# The end-of-sequence id, the filler and the width of the single-EOS rule.
EOS_ID, EOS_FILL, EOS_WIDTH = 2, 0, 512


def _ids(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, for bodies that read it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def pad_to(ids: Column, width: int, fill: int) -> Column:
    """Right-pad; an array that is already long enough is left alone."""
    missing = F.greatest(F.lit(width) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(fill).cast("bigint"), missing))


def lay_out(ids: Column, block: int, layout: str, special: SpecialIds) -> Column:
    """Markers around the first ids of a text, padded to the block."""
    body = F.slice(ids, 1, block - LAYOUT_MARKERS[layout])
    head = _ids(special.cls) if layout == "plain" else _ids(special.cls, special.encoder_only, special.sep)
    return pad_to(F.concat(head, body, _ids(special.sep)), block, special.pad)


def keep_last_eos(ids: Column, eos: int = EOS_ID, fill: int = EOS_FILL, width: int = EOS_WIDTH) -> Column:
    """When the EOS id occurs more than once only its last place stays, then pad to ``width``."""

    def shorten(found: Column) -> Column:
        single = F.filter(found["ids"], lambda x, i: (x != eos) | (i == found["last"]))
        return F.when(found["count"] > 1, pad_to(single, width, fill)).otherwise(found["ids"])

    def locate(x: Column) -> Column:
        last = F.size(x) - F.array_position(F.reverse(x), F.lit(eos).cast("bigint"))
        count = F.size(F.filter(x, lambda item: item == eos))
        return F.struct(x.alias("ids"), last.alias("last"), count.alias("count"))

    return let(let(ids, locate), shorten)


def attention_mask(ids: Column, pad: int) -> Column:
    """1 where the id differs from the filler."""
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def length_mask(n_real: Column, width: int) -> Column:
    """1 for the first ``n_real`` places, whatever ids they hold (filler may equal a real id)."""
    n = F.least(n_real, F.lit(width))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(width) - n))


def last_token_pos(ids: Column, pad: int) -> Column:
    """Place of the last real id: just before the first filler, the end when there is none."""
    first_pad = F.greatest(F.array_position(ids, F.lit(pad).cast("bigint")) - 1, F.lit(0))
    return F.pmod(first_pad - 1, F.size(ids))
