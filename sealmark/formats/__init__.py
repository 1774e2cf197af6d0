"""Canonicalisers by format: a value's bytes in, its canonical bytes out, or a Rejected."""

from __future__ import annotations

from collections.abc import Callable

from . import asn1, cbor, gguf, json, onnx, ring, safetensors, schemas, sexp, xml
from .base import Rejected

FORMATS: dict[str, Callable[[bytes], bytes]] = {
    "json": json.canonicalize,
    "sexp": sexp.canonicalize,
    "xml": xml.canonicalize,
    "asn1": asn1.canonicalize,
    "ring": ring.canonicalize,
    "codemodule": sexp.canonicalize_module,
    "cbor": cbor.canonicalize,
    "gguf": gguf.canonicalize,
    "onnx": onnx.canonicalize,
    "safetensors": safetensors.canonicalize,
    "schema_photo": schemas.photo,
    "schema_document": schemas.article,
    "schema_codemodule_signed": schemas.statement,
}

#: Of formats whose canonical form holds digests, the form before those are made.
SKELETONS = {"gguf": gguf.skeleton, "onnx": onnx.skeleton, "safetensors": safetensors.skeleton}

__all__ = ["FORMATS", "SKELETONS", "Rejected"]
