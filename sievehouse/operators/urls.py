"""Risk of addresses, judged by their text alone; nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import java, matches
from ..plans import signals as S

# Fixed values.
PRIVATE = r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.0\.0\.0$|172\.(1[6-9]|2\d|3[01])\.)"
RAW_IP = r"^\d{1,3}(\.\d{1,3}){3}$"
METADATA = ["169.254.169.254", "metadata.google.internal"]
_PARTS = r"^(https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.trim(url), java(_PARTS, True), 2)), F.lit(""))


def assess(rows: DataFrame, url: str = "url") -> DataFrame:
    """rows with host, plaintext, private_network, metadata_endpoint, sink_host, raw_ip; all null for what is no web address."""
    host = host_of(F.col(url))
    sink = None
    for h in S.HOSTS:
        hit = (host == h) | host.endswith("." + h)
        sink = F.when(hit, F.lit(h)) if sink is None else sink.when(hit, F.lit(h))
    scheme = F.lower(F.regexp_extract(F.trim(F.col(url)), java(_PARTS, True), 1))
    known = lambda c: F.when(host.isNotNull(), c)
    return rows.withColumns(
        {
            "host": host, "plaintext": known(scheme == "http"), "private_network": known(matches(host, PRIVATE, True)),
            "metadata_endpoint": known(host.isin(*METADATA)), "sink_host": sink, "raw_ip": known(matches(host, RAW_IP)),
        }
    )
