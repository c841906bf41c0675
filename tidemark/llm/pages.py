"""One key per page, however its address is written or wrapped."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query keys that name a click, session or referrer, not a page.
NOISE = {
    "fbclid", "gclid", "dclid", "msclkid", "srsltid", "yclid", "igshid", "mc_cid", "mc_eid",
    "sessionid", "session", "sid", "phpsessid", "jsessionid", "ref", "referrer", "mkt", "mkt_tok", "spm", "_ga", "_gl",
}
NOISE_PREFIX = ("utm_", "srsltid", "fbclid", "gclid", "mkt_")
# Host labels of other views of the same site.
VIEWS = ("www.", "m.", "mobile.", "amp.")
# Query keys under which a redirecting address carries its goal.
GOAL = ("url", "u", "target", "dest", "destination", "redirect", "redirect_url", "goto", "to", "link")
_SCHEME = re.compile(r"^[a-z][a-z0-9+.-]*://", re.I)


def page_key(url: str | None) -> str | None:
    """The page an address leads to: wrapped addresses unwrapped, case, port, view, escapes, tracking and order undone.

    None for null and blank. What can't be parsed is its own key.
    """
    if url is None or not url.strip():
        return None
    text = url.strip()
    for _ in range(5):
        try:
            parts = urlsplit(text if _SCHEME.match(text) else "http://" + text)
            host = (parts.hostname or "").rstrip(".")
            port = parts.port
        except ValueError:
            return text
        query = parse_qsl(parts.query, keep_blank_values=True)
        inner = next((v for k, v in query if k.lower() in GOAL and _SCHEME.match(unquote(v).strip())), None)
        if inner is None:
            break
        text = inner.strip() if _SCHEME.match(inner.strip()) else unquote(inner).strip()
    for v in VIEWS:
        if host.startswith(v) and host.count(".") >= 2:
            host = host[len(v) :]
            break
    path = parts.path
    for _ in range(3):
        plain = unquote(path)
        if plain == path:
            break
        path = plain
    path = re.sub(r";jsessionid=[^/;]*", "", re.sub(r"/{2,}", "/", path), flags=re.I).rstrip("/")
    path = re.sub(r"/(index|default)\.html?$", "", path)
    keep = sorted((k, v) for k, v in query if k.lower() not in NOISE and not k.lower().startswith(NOISE_PREFIX))
    port_text = f":{port}" if port not in (None, 80, 443) else ""
    return host + port_text + path + ("?" + "&".join(f"{k}={v}" for k, v in keep) if keep else "")


@F.pandas_udf(T.StringType())
def _page_key(s: pd.Series) -> pd.Series:
    return s.map(page_key)


#: Java pattern of addresses whose key needs no more than cutting off scheme, fragment and last slash.
PLAIN = r"^https?://(?!www\.|m\.|mobile\.|amp\.)[a-z0-9-]++(?:\.[a-z0-9-]++)++(?:/[A-Za-z0-9._~-]++)++/?(?:#.*)?$"


def page_key_column(c: Column) -> Column:
    """page_key() for a column; Python sees only the addresses that aren't plain."""
    plain = c.rlike(PLAIN) & ~c.rlike(r"/(?:index|default)\.html?/?(?:#.*)?$")
    cut = F.regexp_replace(F.regexp_replace(c, r"^https?://", ""), r"/?(?:#.*)?$", "")
    return F.when(plain, cut).otherwise(_page_key(F.when(plain, None).otherwise(c)))
