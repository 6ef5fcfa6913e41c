"""Absolute URL of a link, as an expression over the page URL and the href."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import let

PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Schemes whose links may be relative to the page.
RELATIVE_SCHEMES = (
    "ftp http gopher nntp imap wais file https shttp mms prospero rtsp rtsps rtspu sftp svn svn+ssh ws wss"
).split()


def _parts(url: Column) -> Column:
    names = ("scheme", "authority", "path", "query", "fragment")
    fields = [F.regexp_extract(url, PARTS, i + 1).alias(n) for i, n in enumerate(names)]
    return F.struct(F.lower(fields[0]).alias("scheme"), *fields[1:])


def _merged_path(base_path: Column, path: Column) -> Column:
    """Join a relative path to the base's folder and fold its dot segments."""

    def resolve(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.array_append(acc, s)),
        )
        folder = F.element_at(segments, -1).isin(".", "..")
        joined = F.array_join(F.when(folder, F.array_append(kept, F.lit(""))).otherwise(kept), "/")
        return F.when(joined == "", "/").otherwise(joined)

    def relative(base_segments: Column) -> Column:
        folder = F.when(
            F.element_at(base_segments, -1) != "",
            F.slice(base_segments, 1, F.size(base_segments) - 1),
        ).otherwise(base_segments)
        whole = F.concat(folder, F.split(path, "/"))
        last = F.size(whole) - 1
        return F.filter(whole, lambda s, i: (s != "") | (i == 0) | (i == last))

    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(
        let(F.split(base_path, "/"), relative)
    )
    return let(segments, resolve)


def resolve_url(base: Column, href: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")

    def build(pair: Column) -> Column:
        b, u = pair["b"], pair["u"]
        scheme = F.when(u["scheme"] == "", b["scheme"]).otherwise(u["scheme"])
        own_path = u["path"] != ""
        authority = F.when(u["authority"] == "", b["authority"]).otherwise(u["authority"])
        path = (
            F.when(u["authority"] != "", u["path"])
            .when(own_path, _merged_path(b["path"], u["path"]))
            .otherwise(b["path"])
        )
        query = F.when(
            (u["authority"] == "") & ~own_path & (u["query"] == ""), b["query"]
        ).otherwise(u["query"])
        slash = F.when((authority != "") & (path != "") & ~path.startswith("/"), "/").otherwise("")
        joined = F.concat(
            scheme,
            F.lit("://"),
            authority,
            slash,
            path,
            F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
            F.when(u["fragment"] == "", "").otherwise(F.concat(F.lit("#"), u["fragment"])),
        )
        return F.when(
            (scheme != b["scheme"]) | ~scheme.isin(*RELATIVE_SCHEMES), clean
        ).otherwise(joined)

    pair = F.struct(_parts(base).alias("b"), _parts(clean).alias("u"))
    return F.when(clean == "", base).when(base == "", clean).otherwise(let(pair, build))
