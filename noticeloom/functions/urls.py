"""URLs: repair, hosts, registrable domains, trust by host, look-alikes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Second levels under .kr and hosts of public bodies.
KR_SECOND = ("go", "or", "co", "ne", "re", "pe", "ac", "hs", "ms", "es", "sc", "kg")
PUBLIC = ("k-startup.go.kr", "bizinfo.go.kr", "mss.go.kr", "youthcenter.go.kr", "smtech.go.kr", "kocca.kr", "kosmes.or.kr", "semas.or.kr", "sbiz24.kr")
#: Networks that no fetch may reach.
PRIVATE_V4 = r"^(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.0\.[02]\.|^192\.168\.|^198\.(?:1[89]|51)\.|^203\.0\.113\."


def repaired(url: Column) -> Column:
    """Trimmed, ampersands decoded, https:// before a bare host."""
    u = F.regexp_replace(F.trim(url), "(?i)&amp;", "&")
    return F.when(u.rlike(r"^[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:[/:?#]|$)") & ~u.contains("://"), F.concat(F.lit("https://"), u)).otherwise(u)


def host(url: Column) -> Column:
    """Host in lower case without a last dot; null where the URL has none."""
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\[\]]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(h), r"\.$", ""), F.lit(""))


def port(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:@]+:([0-9]+)", 1), F.lit(""))


def registrable(h: Column) -> Column:
    """The last two labels, three where the second level belongs to a country's scheme."""
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    n = F.size(labels)
    three = (F.element_at(labels, -1) == "kr") & F.try_element_at(labels, F.lit(-2)).isin(*KR_SECOND)
    take = F.when(n <= 2, n).when(three, 3).otherwise(2)
    return F.array_join(F.slice(labels, n - take + 1, take), ".")


def first_label(domain: Column) -> Column:
    return F.element_at(F.split(domain, r"\."), 1)


def is_ip(h: Column) -> Column:
    return h.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") | h.contains(":")


def blocked(url: Column) -> Column:
    """Whether a fetch must refuse: scheme, credentials, local names, private addresses. Names aren't resolved here."""
    h = host(url)
    local = (h == "localhost") | h.rlike(r"\.(?:localhost|local|internal)$")
    return F.coalesce(~url.rlike(r"(?i)^https?://") | url.rlike(r"^[^/]*//[^/?#]*@") | h.isNull() | local | h.rlike(PRIVATE_V4), F.lit(True))


def tier(url: Column, public: tuple[str, ...] = PUBLIC, public_suffix: str = ".go.kr") -> Column:
    """tier1 for public bodies, tier3 for what looks like deceit, else tier2. public is a fixed policy list."""
    known = F.array(*[F.struct(F.lit(w).alias("host"), F.lit(w.split(".")[0]).alias("label")) for w in public]).cast("array<struct<host:string,label:string>>")
    odd_port = port(url).isNotNull() & ~port(url).isin("80", "443")

    def near(x: Column) -> Column:
        close = lambda w: F.levenshtein(x["domain"], w["host"]).between(1, 2) | (F.length(x["label"]) >= 5) & (F.length(w["label"]) >= 5) & F.levenshtein(x["label"], w["label"]).between(1, 2)
        return F.exists(known, close)

    def decide(x: Column) -> Column:
        h = x["host"]
        trusted = h.endswith(public_suffix) | F.exists(known, lambda w: (h == w["host"]) | h.endswith(F.concat(F.lit("."), w["host"])))
        return F.when(h.isNull() | is_ip(h) | h.rlike(r"(?:^|\.)xn--") | odd_port, "tier3").when(trusted, "tier1").when(near(x), "tier3").otherwise("tier2")

    # host, domain and label are made once, as lambdas' own values; outside they would be made again for each known host
    hosts = F.transform(F.array(host(url)), lambda h: F.struct(h.alias("host"), registrable(h).alias("domain")))
    parts = F.transform(hosts, lambda x: F.struct(x["host"].alias("host"), x["domain"].alias("domain"), first_label(x["domain"]).alias("label")))
    return F.get(F.transform(parts, decide), F.lit(0))


def sibling(url: Column) -> Column:
    """The other address of a page, null where there is none: that of its board's other state, or a blog's mobile form.

    Fixed values: the board k-startup.go.kr keeps open and closed calls (with a pbancSn) under two names; one blog host.
    """
    h = host(url)
    board = ((h == "k-startup.go.kr") | h.endswith(".k-startup.go.kr")) & url.rlike(r"[?&]pbancSn=[^&#]+")
    state = F.regexp_extract(url, r"^[^?#]*/bizpbanc-(ongoing|deadline)\.do(?:[?#]|$)", 1)
    other = F.when(state == "ongoing", "deadline").when(state == "deadline", "ongoing")
    swapped = F.concat(F.regexp_extract(url, r"^([^?#]*/bizpbanc-)", 1), other, F.regexp_extract(url, r"^[^?#]*/bizpbanc-(?:ongoing|deadline)(.*)$", 1))
    blog = F.when(h.isin("blog.naver.com", "www.blog.naver.com"), F.regexp_replace(url, r"(?i)^(https?://)(?:[^/?#@]*@)?(?:www\.)?blog\.naver\.com", "$1m.blog.naver.com"))
    return F.coalesce(F.when(board, swapped), blog)


def slug_title(url: Column) -> Column:
    """A title from the last part of a path: trailing hash dropped, hyphens as blanks, percent signs decoded."""
    last = F.regexp_extract(url, r"([^/?#]+)/?(?:[?#].*)?$", 1)
    plain = F.regexp_replace(F.regexp_replace(last, "-?[0-9a-f]{32}$", ""), "-+", " ")
    return F.trim(F.try_url_decode(F.regexp_replace(plain, r"%(?![0-9A-Fa-f]{2})", "%25")))
