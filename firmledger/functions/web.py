"""URLs, hosts, domains and social profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import with_stage
from .text import LEGAL_NAME_STOP, tokens

# Social hosts, in the order they are tried.
SOCIAL_HOSTS = {
    "linkedin.com": "linkedin",
    "facebook.com": "facebook",
    "instagram.com": "instagram",
    "x.com": "x",
    "twitter.com": "x",
    "youtube.com": "youtube",
    "youtu.be": "youtube",
    "tiktok.com": "tiktok",
}
# First path segments that mark a share button, an event or a post.
SOCIAL_REJECTED_FIRST = {
    "facebook": (
        "sharer", "sharer.php", "share.php", "dialog", "policy.php", "privacy", "events", "groups", "plugins",
        "profile.php",
    ),
    "instagram": ("p", "reel", "reels", "stories", "explore"),
    "x": ("intent", "share", "home", "search", "i"),
}
# Public suffixes of more than one label that occur in the registry's country and neighbours.
MULTI_LABEL_SUFFIXES = (
    "co.no", "gs.no", "kommune.no", "priv.no", "uenorge.no", "stat.no", "dep.no", "mil.no", "herad.no", "vgs.no",
    "folkebibl.no", "fhs.no", "museum.no", "idrett.no", "fylkesbibl.no",
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "com.br", "co.jp", "co.nz", "com.tr",
)

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _SCHEME, 1))


def url_authority(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def url_host(url: Column) -> Column:
    """Lower-case host without user info and port; empty when the text is no absolute URL.

    A pattern instead of ``parse_url``: the built-in returns null on raw non-ASCII paths.
    """
    host = F.regexp_replace(F.regexp_replace(url_authority(url), r"^.*@", ""), r":[0-9]*$", "")
    return F.lower(host)


def bare_host(url: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(url_host(url), r"^www\.", "")


def hosts_related(left: Column, right: Column) -> Column:
    """Equal hosts, or one below the other."""
    return (
        (left != "")
        & (right != "")
        & (
            (left == right)
            | F.endswith(left, F.concat(F.lit("."), right))
            | F.endswith(right, F.concat(F.lit("."), left))
        )
    )


def same_site(left: Column, right: Column) -> Column:
    return hosts_related(F.rtrim(url_host(left), F.lit(".")), F.rtrim(url_host(right), F.lit(".")))


def is_http(url: Column) -> Column:
    return F.coalesce(url, F.lit("")).rlike(r"^https?://")


def normalize_homepage(value: Column) -> Column:
    """Absolute http(s) address without parameters, query and fragment; null when there is none."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    absolute = F.when(raw.rlike(r"(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    path = F.regexp_replace(url_path(absolute), r";[^/]*$", "")
    clean = F.concat(
        url_scheme(absolute),
        F.lit("://"),
        url_authority(absolute),
        F.when(path == "", F.lit("/")).otherwise(path),
    )
    return F.when((raw != "") & (url_host(absolute) != ""), clean)


def path_segments(url: Column) -> Column:
    """Lower-case non-empty path segments."""
    return F.filter(F.split(F.lower(url_path(url)), "/"), lambda part: F.trim(part) != "")


def is_valid_domain(value: Column) -> Column:
    """Dotted ASCII name with legal labels and an alphabetic top level of two letters or more."""
    domain = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"^[\s.]+|[\s.]+$", ""))
    return (F.length(domain) <= 253) & domain.rlike(
        r"^(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"
    )


def normalize_domain(value: Column) -> Column:
    """Lower-case domain, or null when it is not valid."""
    domain = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"^[\s.]+|[\s.]+$", ""))
    return F.when(is_valid_domain(value), domain)


def registered_domain(url: Column) -> Column:
    """Name plus public suffix: three labels below a known two-label suffix, else the last two."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    count = F.size(labels)
    last_two = F.concat_ws(".", F.slice(labels, F.greatest(count - 1, F.lit(1)), 2))
    last_three = F.concat_ws(".", F.slice(labels, F.greatest(count - 2, F.lit(1)), 3))
    known = last_two.isin(*MULTI_LABEL_SUFFIXES)
    numeric = host.rlike(r"^[0-9.]+$")
    return F.when((count < 2) | numeric | (known & (count < 3)), F.lit("")).when(known, last_three).otherwise(last_two)


def site_label_tokens(domain: Column) -> Column:
    """Name tokens of an unambiguous two-label site (``www.`` ignored); else empty."""
    clean = F.regexp_replace(F.coalesce(normalize_domain(domain), F.lit("")), r"^www\.(?=[^.]+\.[^.]+$)", "")
    label = F.when(clean.rlike(r"^[^.]+\.[^.]+$"), F.element_at(F.split(clean, r"\."), 1)).otherwise(F.lit(""))
    return F.filter(tokens(label), lambda token: ~token.isin(*LEGAL_NAME_STOP))


def domain_of(url_or_domain: Column) -> Column:
    """Valid domain of an address or of a bare domain; empty when there is none."""
    raw = F.trim(F.coalesce(url_or_domain, F.lit("")))
    return F.coalesce(normalize_domain(F.when(F.instr(raw, "://") > 0, url_host(raw)).otherwise(raw)), F.lit(""))


def with_social_profile(rows: DataFrame, url: Column, name: str = "profile") -> DataFrame:
    """Add struct(platform, url) of the canonical company profile an address names.

    The struct is null for shares, posts, events and other hosts. Host, parts and platform are columns of their own
    on the way, so each is computed once per row.
    """
    rows = rows.withColumn("_url", url)
    rows = rows.withColumn("_host", bare_host(F.col("_url"))).withColumn(
        "_parts", F.filter(F.transform(F.split(url_path(F.col("_url")), "/"), lambda item: F.trim(item)), lambda part: part != "")
    )
    host, parts = F.col("_host"), F.col("_parts")
    known = "|".join(domain.replace(".", r"\.") for domain in SOCIAL_HOSTS)
    labels = F.create_map(*[F.lit(item) for pair in SOCIAL_HOSTS.items() for item in pair])
    platform = labels[F.regexp_extract(host, rf"(?:^|\.)({known})$", 1)]
    rows = with_stage(rows, "_platform", platform).withColumn("_first", F.coalesce(F.try_element_at("_parts", F.lit(1)), F.lit("")))
    platform, first = F.col("_platform"), F.col("_first")
    lowered, count = F.lower(first), F.size(parts)
    handle = F.startswith(first, F.lit("@"))
    rejected = F.lit(False)
    for label, names in SOCIAL_REJECTED_FIRST.items():
        rejected = rejected | ((platform == label) & lowered.isin(*names))
    allowed = (
        F.when(platform == "linkedin", (lowered == "company") & (count >= 2))
        .when(platform == "youtube", (lowered.isin("channel", "user", "c") | handle) & (host != "youtu.be"))
        .when(platform == "tiktok", handle)
        .when(platform == "x", count == 1)
        .otherwise(F.lit(True))
    )
    kept = (
        F.when(platform == "linkedin", F.slice(parts, 1, 2))
        .when((platform == "youtube") & handle, F.slice(parts, 1, 1))
        .when(platform == "youtube", F.slice(parts, 1, 2))
        .otherwise(parts)
    )
    canonical = F.concat(F.lit("https://"), platform, F.lit(".com/"), F.array_join(kept, "/"))
    profile = F.when(
        platform.isNotNull() & (count > 0) & ~rejected & allowed,
        F.struct(platform.alias("platform"), canonical.alias("url")),
    )
    return with_stage(rows, name, profile).drop("_url", "_host", "_parts", "_platform", "_first")


def detail_page(url: Column, generic_segments: tuple[str, ...], query_keys: tuple[str, ...] = ()) -> Column:
    """A page below a section root: the last section segment is followed by another one."""
    segments = path_segments(url)
    marked = F.transform(segments, lambda part, index: F.when(part.isin(*generic_segments), index).otherwise(F.lit(-1)))
    last = F.array_max(marked)
    deeper = (last >= 0) & (last < F.size(segments) - 1)
    if query_keys:
        query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
        keys = F.transform(F.split(query, "&"), lambda pair: F.lower(F.regexp_extract(pair, r"^([^=]+)=.", 1)))
        wanted = F.array(*[F.lit(key) for key in query_keys])
        deeper = deeper | F.arrays_overlap(keys, wanted)
    return F.coalesce((F.size(segments) > 0) & deeper, F.lit(False))


def non_root_page(url: Column, generic_segments: tuple[str, ...]) -> Column:
    """Any page but the home page and a bare section root."""
    segments = path_segments(url)
    lone = (F.size(segments) == 1) & F.coalesce(F.try_element_at(segments, F.lit(1)), F.lit("")).isin(*generic_segments)
    return (F.size(segments) > 0) & ~lone


def without_dots(url: Column) -> Column:
    """An address whose path has no ``.`` and ``..`` segments left; other addresses stay as they are."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"(/\.\.?)$", "$1/")
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(part))),
    )
    dotted = (head != "") & path.rlike(r"/\.\.?/")
    return F.when(dotted, F.concat(head, F.array_join(kept, "/"), F.regexp_extract(url, r"([?#].*)?$", 0))).otherwise(url)


def resolve_link(base_url: Column, href: Column) -> Column:
    """Absolute form of a link: absolute, scheme-relative, root-relative, or relative to the base folder; dot segments go."""
    link = F.trim(F.coalesce(href, F.lit("")))
    origin = F.concat(url_scheme(base_url), F.lit("://"), url_authority(base_url))
    folder = F.regexp_replace(url_path(base_url), r"[^/]*$", "")
    found = (
        F.when(link.rlike(_SCHEME) | link.rlike(r"^(?:mailto|tel|javascript|data):"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(url_scheme(base_url), F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(link == "", F.coalesce(base_url, F.lit("")))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(F.coalesce(base_url, F.lit("")), r"#.*$", ""), link))
        .when(
            F.startswith(link, F.lit("?")),
            F.concat(F.regexp_replace(F.coalesce(base_url, F.lit("")), r"[?#].*$", ""), link),
        )
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )
    return without_dots(found)
