"""Links, mentions, short links, identifiers and digests."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

# The patterns by which links and mentions are told from text, and the prefix of short links.
URL_PATTERN = r"(http://|https://)([a-zA-Z0-9_!~*'().&=+$%-]+)"
MENTION_PATTERN = r"@([a-zA-Z0-9\-_]+)"
SHORT_URL_PREFIX = "http://short-url/"


def extract_urls(text: Column) -> Column:
    """All links in order; a link ends at the first slash behind its host."""
    return F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0))


def extract_mentions(text: Column) -> Column:
    """All mentioned names in order, repeats kept, without the at sign."""
    return F.regexp_extract_all(text, F.lit(MENTION_PATTERN), F.lit(1))


def short_url(url: Column, salt: str = "") -> Column:
    """A short link that depends on the link alone: ten digits of its SHA-256, so retries agree."""
    return F.concat(F.lit(SHORT_URL_PREFIX), F.substring(F.sha2(F.concat(url, F.lit(salt)), 256), 1, 10))


def shorten_text(text: Column, short: Column) -> Column:
    """Puts the n-th short link in the place of the n-th link. Without links the text stays as it is."""
    pieces = F.split(text, URL_PATTERN, -1)
    filled = F.zip_with(pieces, short, lambda p, s: F.concat(F.coalesce(p, F.lit("")), F.coalesce(s, F.lit(""))))
    return F.when(F.size(extract_urls(text)) == 0, text).otherwise(F.array_join(filled, ""))


def salted_sha256(password: Column, salt: Column) -> Column:
    """Lowercase hex SHA-256 of the password followed by its salt."""
    return F.sha2(F.concat(password, salt), 256)


def is_blank(value: Column) -> Column:
    """Null or the empty string."""
    return F.coalesce(value, F.lit("")) == ""


def bucket_of(power: int, *keys: Column) -> Column:
    """The bucket of a key among 2^power."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << power))


def unique_id(machine: Column, millis: Column, counter: Column) -> Column:
    """Hex of machine (3 digits), time (10 digits) and counter (3 digits), read as 63 bits."""

    def digits(value: Column, n: int) -> Column:
        return F.lpad(F.right(F.lower(F.hex(value)), F.lit(n)), n, "0")

    full = F.concat(digits(machine, 3), digits(millis, 10), digits(counter, 3))
    value = F.conv(full, 16, 10).cast("decimal(20,0)")
    return F.when(value >= F.lit(str(1 << 63)).cast("decimal(20,0)"), value - F.lit(str(1 << 63)).cast("decimal(20,0)")).otherwise(value).cast("long")


def machine_id(name: Column) -> Column:
    """Three hex digits that stand for a machine's name."""
    return F.lpad(F.right(F.hex(F.pmod(F.xxhash64(name), F.lit(1 << 16))), F.lit(3)), 3, "0")


def timeline_json(ids: Column) -> Column:
    """A timeline for rendering: post ids as strings, since 64-bit ids don't fit JavaScript numbers."""
    return F.to_json(F.struct(F.transform(ids, lambda i: i.cast("string")).alias("post_ids")))


def jwt(payload: dict, secret: str) -> str:
    """An HS256 token for one request."""
    part = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=")
    body = b".".join(part(json.dumps(x, separators=(",", ":"), sort_keys=True).encode()) for x in ({"alg": "HS256", "typ": "JWT"}, payload))
    return (body + b"." + part(hmac.new(secret.encode(), body, hashlib.sha256).digest())).decode()


def jwt_column(user_id: Column, username: Column, timestamp: Column, secret: str, ttl: int = 3600) -> Column:
    """HS256 tokens for a column of logins. Keyed hashing has no built-in expression, hence Arrow batches."""

    @pandas_udf("string")
    def sign(u: pd.Series, n: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else jwt({"user_id": str(int(a)), "username": b, "timestamp": str(int(c)), "ttl": str(ttl)}, secret) for a, b, c in zip(u, n, t, strict=True)])

    return sign(user_id, username, timestamp)


def token_expired(timestamp: Column, now: Column, ttl: int = 3600) -> Column:
    """True once timestamp + ttl lies before now."""
    return timestamp + F.lit(ttl) < now
