"""URL checks and joining."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfscope.functions.bind import let

_ABSOLUTE = r"^[\x00-\x20]*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)"


def is_valid_url(url: Column) -> Column:
    """Whether the URL has a scheme and a host part."""
    host = F.regexp_extract(url, _ABSOLUTE, 1)
    brackets = host.contains("[") == host.contains("]")
    return F.coalesce((F.length(host) > 0) & brackets, F.lit(False))


def is_shop_url(url: Column, domain: str) -> Column:
    """Whether the URL mentions the shop's domain."""
    return F.coalesce(url.contains(domain), F.lit(False))


# the generic form of a URI reference: scheme, authority, path, query, fragment, the
# first, second, fourth and fifth with their marks, so that empty differs from missing
_PARTS = r"(?s)^([^:/?#]+:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _split(reference: Column) -> Column:
    names = ("scheme", "authority", "path", "query", "fragment")
    return F.struct(*[F.regexp_extract(reference, _PARTS, i).alias(n) for i, n in enumerate(names, 1)])


def remove_dot_segments(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; a ``..`` takes the segment before it along."""
    rooted = F.regexp_replace(F.regexp_replace(path, r"^(?:\.\.?/)+", ""), r"^\.\.?$", "")

    def folded(p: Column) -> Column:
        # a segment comes with the slash before it
        segments = F.filter(F.regexp_extract_all(p, F.lit("/?[^/]*"), F.lit(0)), lambda s: s != "")

        def step(stack: Column, s: Column) -> Column:
            return (
                F.when(s == "/.", stack)
                .when(s == "/..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))))
                .otherwise(F.array_append(stack, s))
            )

        kept = F.aggregate(segments, F.array().cast("array<string>"), step)
        end = F.when(p.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.array_join(kept, ""), end)

    return let(rooted, lambda p: F.when(p.contains("/."), folded(p)).otherwise(p))


def resolve(reference: Column, base: Column) -> Column:
    """A URI reference resolved against an absolute base, by RFC 3986, section 5.2 (strict)."""

    def joined(both: Column) -> Column:
        r, b = both["r"], both["b"]
        merged = F.when((b["authority"] != "") & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(
            F.concat(F.regexp_extract(b["path"], "(?s)^.*/", 0), r["path"])
        )
        own_path = (r["scheme"] != "") | (r["authority"] != "") | r["path"].startswith("/")
        path = (
            F.when(own_path, remove_dot_segments(r["path"]))
            .when(r["path"] != "", remove_dot_segments(merged))
            # an authority without a path is all there is
            .when(r["authority"] != "", F.lit("")).otherwise(b["path"])
        )
        same_page = (r["scheme"] == "") & (r["authority"] == "") & (r["path"] == "") & (r["query"] == "")
        authority = F.when((r["scheme"] != "") | (r["authority"] != ""), r["authority"]).otherwise(b["authority"])
        return F.concat(
            F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"]),
            authority,
            path,
            F.when(same_page, b["query"]).otherwise(r["query"]),
            r["fragment"],
        )

    return let(F.struct(_split(reference).alias("r"), _split(base).alias("b")), joined)


def normalize_url(link: Column, base: Column) -> Column:
    """An absolute URL for a link found on ``base``; an empty one for a missing link."""
    absolute = link.startswith("http://") | link.startswith("https://")
    no_base = base.isNull() | (F.length(base) == 0)
    return (
        F.when(link.isNull() | (F.length(link) == 0), F.lit(""))
        .when(absolute | no_base, link)
        .otherwise(resolve(link, base))
    )
