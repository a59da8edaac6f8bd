"""Identity: name-based version-5 ids, and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL namespace of RFC 4122.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The version-5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.substr(variant, nibble + 1, F.lit(1)), F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def chunk_id(version: Column, document: Column, content: Column) -> Column:
    return uuid5(F.concat_ws(":", version, document, content))


def content_key(document: Column, content: Column) -> Column:
    """As chunk_id, for all versions."""
    return uuid5(F.concat_ws(":", document, content))


def cache_key(version: Column, mentions: Column, prompt: Column, question: Column) -> Column:
    """SHA-256 of the request with keys in order; mentions in any order and the question's case do not matter."""
    quoted = F.transform(F.array_sort(mentions), lambda m: F.concat(F.lit('"'), m, F.lit('"')))
    text = F.concat(
        F.lit('{"cv": "'), version, F.lit('", "m": ['), F.array_join(quoted, ", "), F.lit('], "pv": "'), prompt,
        F.lit('", "q": "'), F.lower(F.trim(question)), F.lit('"}'),
    )
    return F.sha2(text, 256)
