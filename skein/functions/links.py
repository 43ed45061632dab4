"""Publishers of web links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts of catalogues, whose own records say nothing new about an entry.
CATALOGUE_HOSTS = ("malpedia.caad.fkie.fraunhofer.de", "attack.mitre.org", "apt.etda.or.th")


def domain(url: Column) -> Column:
    """Host and port in lower case, without user and a leading www.; empty for what is no link."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), r"\A[^@]*@", "")
    return F.coalesce(F.regexp_replace(host, r"\Awww\.", ""), F.lit(""))


def is_catalogue(host: Column) -> Column:
    return host.isin(*CATALOGUE_HOSTS)
