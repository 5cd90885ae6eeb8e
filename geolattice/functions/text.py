"""String functions: natural order, names from paths, gray levels for colour ramps, signed URLs."""

from __future__ import annotations

import base64
import hashlib
import hmac
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 20


def natural_key(s: Column) -> Column:
    """Sort key in which runs of digits compare as numbers: they are padded to one length."""
    parts = F.regexp_extract_all(s, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), DIGITS, "0")).otherwise(p)), "")


def without_suffix(name: Column) -> Column:
    """A file name without .jpg or .png at its end (the ending itself, not a set of characters)."""
    return F.regexp_replace(name, r"\.(jpg|png)$", "")


def stripped_suffix(name: Column) -> Column:
    """Legacy names: all trailing characters out of '.jpg', then out of '.png', go."""
    return F.regexp_replace(F.regexp_replace(name, r"[.jpg]+$", ""), r"[.png]+$", "")


def path_to_name(path: Column) -> Column:
    return F.translate(path, "/", "_")


def starts_with_pattern(path: Column, pattern: str) -> Column:
    """Whether a pattern matches from the start; what follows is free."""
    return path.rlike(f"^(?:{pattern})")


def signature(url: str, secret: str) -> str:
    """URL-safe base64 HMAC-SHA1 of a URL's path and query under a URL-safe base64 key."""
    if not url or not secret:
        raise ValueError("both url and secret are needed")
    parts = urlsplit(url)
    digest = hmac.new(base64.urlsafe_b64decode(secret), f"{parts.path}?{parts.query}".encode(), hashlib.sha1).digest()
    return base64.urlsafe_b64encode(digest).decode()


def signed_url(url: Column, secret: str) -> Column:
    """URLs with their signature appended; NULL stays NULL."""

    @F.pandas_udf("string")
    def sign(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: None if u is None else f"{u}&signature={signature(u, secret)}")

    return sign(url)


def ramp(x: Column) -> Column:
    """struct(r, g): clipped linear ramp from red at 0 to green at 1."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 2
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 - t)).alias("r"), F.least(F.lit(1.0), t).alias("g"))
