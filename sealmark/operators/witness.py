"""Witnesses: what is kept of an address so that it can be checked again, as plain data.

`verify` compares a witness with itself (label, axis and digest must agree); `reverify` canonicalises and
hashes the value again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.labels import label_of_digest, label_width
from .address import address

#: Version of the witness's fields.
FORM = 1


def mint(outcome: Column) -> Column:
    """struct<label, axis, digest, canonical_len, form> of an outcome that is ok, else null."""
    fields = F.struct(outcome["label"].alias("label"), outcome["axis"].alias("axis"), outcome["digest"].alias("digest"), outcome["canonical_len"].alias("canonical_len"), F.lit(FORM).alias("form"))
    return F.when(outcome["status"] == "ok", fields)


def kappa_label(witness: Column) -> Column:
    return witness["label"]


def content_digest(witness: Column) -> Column:
    """The canonical form's digest."""
    return witness["digest"]


def verify(witness: Column) -> Column:
    """ok, replay_failed (fields missing, of another form or width) or fingerprint_mismatch."""
    again = F.concat(witness["axis"], F.lit(":"), F.lower(F.hex(witness["digest"])))
    whole = witness["label"].isNotNull() & witness["digest"].isNotNull() & (witness["form"] == FORM) & (F.length(witness["label"]) == label_width(witness["axis"]))
    return F.when(~F.coalesce(whole, F.lit(False)), "replay_failed").when(again != witness["label"], "fingerprint_mismatch").otherwise("ok")


def reverify(value: Column | str, format_: str, axis: str, witness: Column) -> Column:
    """Whether the value still has the witness's label."""
    return F.coalesce(address(value, format_, axis)["label"] == witness["label"], F.lit(False))


__all__ = ["FORM", "content_digest", "kappa_label", "label_of_digest", "mint", "reverify", "verify"]
