"""Documents that must be JSON of a certain shape: photographs, articles and signed statements.

Their canonical form is JSON's; whatever is wrong is one rejection, `schema_violation`.
"""

from __future__ import annotations

import json as _json
import re
from collections.abc import Callable

from . import json
from .base import Rejected, nfc

# Contexts, types, and the statement's identifier.
CONTEXTS = ("https://schema.org", "http://schema.org")
ARTICLES = (
    "Article", "NewsArticle", "Report", "ScholarlyArticle", "SocialMediaPosting", "TechArticle", "BlogPosting", "AdvertiserContentArticle",
    "AnalysisNewsArticle", "AskPublicNewsArticle", "BackgroundNewsArticle", "OpinionNewsArticle", "ReportageNewsArticle", "ReviewNewsArticle", "SatiricalArticle",
)
AGENTS = ("Person", "Organization")
STATEMENT = "https://in-toto.io/Statement/v1"


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    return {nfc(k): v for k, v in pairs}


def _text(value: object) -> str | None:
    return nfc(value) if isinstance(value, str) else None


def _agent(value: object) -> bool:
    if isinstance(value, str):
        return True
    return isinstance(value, dict) and _text(value.get("@type")) in AGENTS and isinstance(value.get("name"), str)


def is_photo(d: dict) -> bool:
    return _text(d.get("@context")) in CONTEXTS and d.get("@type") == "Photograph" and isinstance(d.get("contentUrl"), str) and _agent(d.get("creator"))


def is_article(d: dict) -> bool:
    author = d.get("author")
    agents = author if isinstance(author, list) else [author]
    return (
        _text(d.get("@context")) in CONTEXTS
        and d.get("@type") in ARTICLES
        and isinstance(d.get("headline"), str)
        and bool(agents)
        and all(map(_agent, agents))
        and bool(_text(d.get("datePublished")))
    )


def is_statement(d: dict) -> bool:
    subject = d.get("subject")

    def signed(s: object) -> bool:
        if not isinstance(s, dict) or not _text(s.get("name")) or not isinstance(s.get("digest"), dict):
            return False
        sha = s["digest"].get("sha256")
        return isinstance(sha, str) and re.fullmatch("[0-9a-f]{64}", sha, re.A) is not None

    return d.get("_type") == STATEMENT and isinstance(subject, list) and bool(subject) and all(map(signed, subject)) and bool(_text(d.get("predicateType"))) and isinstance(d.get("predicate"), dict)


def _admitted(test: Callable[[dict], bool]) -> Callable[[bytes], bytes]:
    def canonicalize(raw: bytes) -> bytes:
        try:
            out = json.canonicalize(raw)
            value = _json.loads(raw.decode(), object_pairs_hook=_pairs)
        except (Rejected, ValueError) as e:
            raise Rejected("schema_violation") from e
        if not isinstance(value, dict) or not test(value):
            raise Rejected("schema_violation")
        return out

    return canonicalize


photo, article, statement = map(_admitted, (is_photo, is_article, is_statement))
