"""Stable identities: content hashes, canonical URLs, document ids and duplicate flags."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query keys that only track visitors, in lower case; the prefix and length of document ids.
ID_PREFIX, ID_HEX = "fed_", 24
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
DEFAULT_PORTS = {"http": "80", "https": "443"}

_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _reencoded(part: Column) -> Column:
    """Decoded and encoded again: space as plus, tilde kept, asterisk escaped."""
    plain = F.coalesce(F.call_function("try_url_decode", part), part)
    return F.replace(F.replace(F.url_encode(plain), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_url(url: Column) -> Column:
    """One spelling for each address, or '' for what is no web address.

    Scheme and host in lower case without user, default port and fragment; runs of slashes in the path
    made one and the last one dropped, except at the root; tracking keys dropped, the other pairs
    sorted and encoded alike, empty values kept.
    """
    url = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(url, _URL, 1))
    authority = F.regexp_replace(F.regexp_extract(url, _URL, 2), "^.*@", "")
    host = F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(authority, r":([^:\]]*)$", 1)
    number = F.when(port.rlike("^[0-9]{1,5}$"), port.cast("int"))
    default = F.coalesce(*(F.when(scheme == s, number == int(p)) for s, p in DEFAULT_PORTS.items()), F.lit(False))
    path = F.regexp_replace(F.regexp_extract(url, _URL, 3), "/{2,}", "/")
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    pairs = F.filter(F.split(F.regexp_extract(url, _URL, 4), "&"), lambda p: p != "")
    keyed = F.transform(pairs, lambda p: F.struct(_reencoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), _reencoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(keyed, lambda p: ~F.lower(p["k"]).isin(*TRACKING_KEYS)))
    query = F.concat_ws("&", F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])))
    sound = scheme.isin(*DEFAULT_PORTS) & (host != "") & ((port == "") | (F.coalesce(number, F.lit(99999)) <= 65535))
    whole = F.concat(
        scheme, F.lit("://"), host, F.when(number.isNull() | default, F.lit("")).otherwise(F.concat(F.lit(":"), number.cast("string"))),
        path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(sound, whole).otherwise(F.lit(""))


def document_id(canonical: Column, sha: Column) -> Column:
    """From the canonical URL or, where there is none, from the content."""
    basis = F.when(canonical != "", canonical).otherwise(F.concat(F.lit("content:"), sha))
    return F.concat(F.lit(ID_PREFIX), F.substring(F.sha2(basis, 256), 1, ID_HEX))


def flag_copies(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], repeated: str, later: str) -> DataFrame:
    """Whether other rows have the same keys (all of them are marked, and nulls are equal), and whether an earlier
    one has. ``order`` tells rows with the same keys apart. Keys are counted before the shuffle and joined back, so
    that those of a third of all rows need no task of their own."""
    groups = df.groupBy(*(F.struct(F.col(k)).alias(f"__{k}") for k in keys)).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(*order)).alias("__first"))
    same = reduce(and_, (F.struct(F.col(k)) == F.col(f"__{k}") for k in keys))
    flagged = df.join(groups, same)
    return flagged.select(*(df[c] for c in df.columns), (F.col("__n") > 1).alias(repeated), (F.struct(*order) > F.col("__first")).alias(later))


def identifier(c: Column) -> Column:
    """A model's or tokenizer's name as names are compared: slashes one way, none at the end, in lower case."""
    return F.lower(F.rtrim(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), F.lit("/")))


def require_pair(tokenizer: str, model: str) -> None:
    """A tokenizer and a model must come from one checkpoint."""
    names = [x.strip().replace("\\", "/").rstrip("/").casefold() for x in (tokenizer, model)]
    if not all(names) or names[0] != names[1]:
        raise ValueError(f"tokenizer {tokenizer!r} does not match model {model!r}")
