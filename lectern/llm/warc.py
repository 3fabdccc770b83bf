"""WARC records, and the resolution of not-modified revisits."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

#: Header fields that a not-modified answer may renew (fixed values: those that RFC 9110 section 15.4.5 has a server send with it).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Profiles of revisit records (fixed values of WARC 1.1; the names of WARC 1.0 end alike).
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, kind string, profile string, url string, ts timestamp, status int, headers map<string,string>, payload_digest string, payload binary"


def head(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, header fields (lower-case names; a repeated field's values joined by commas) and what follows the blank line."""
    top, _, rest = block.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return lines[0], out, rest


def records(data: bytes):
    """(WARC header fields, block) of each record; what follows a damaged record is left out."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        line, fields, _ = head(data[at : end + 4])
        if not line.startswith("WARC/") or not fields.get("content-length", "").isdigit():
            return
        begin = end + 4
        at = begin + int(fields["content-length"])
        if at > len(data):
            return
        yield fields, data[begin:at]
        at += 4


def read_records(df: DataFrame, warc_col: str = "warc") -> DataFrame:
    """The response and revisit records of a column of WARC bytes, one row each: (record_id, kind, profile, url, ts, status, headers, payload_digest,
    payload). headers are those of the HTTP answer; the digest is the record's, or else computed for responses. Null and damaged bytes
    give no rows, or those before the damage."""

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(0).to_pylist():
                for fields, block in records(data or b""):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    line, http, payload = head(block)
                    code = line.split(" ")[1] if line.startswith("HTTP/") and " " in line else ""
                    digest = fields.get("warc-payload-digest") or ("sha256:" + hashlib.sha256(payload).hexdigest() if kind == "response" else None)
                    rows.append((fields.get("warc-record-id"), kind, fields.get("warc-profile"), fields.get("warc-target-uri", "").strip("<>"), fields.get("warc-date"), int(code) if code.isdigit() else None, list(http.items()), digest, payload if kind == "response" else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["record_id", "kind", "profile", "url", "at", "status", "headers", "payload_digest", "payload"])

    got = df.select(warc_col).mapInArrow(run, SCHEMA.replace("ts timestamp", "at string"))
    return got.withColumn("at", F.try_to_timestamp("at")).withColumnRenamed("at", "ts")


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. and default port, https for http, no fragment, no tracking parameters (utm_*, ref), the others
    sorted, no slash at the end of the path."""
    plain = F.regexp_replace(url, "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r"(^www\.)|(:(80|443)$)", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)")))
    return F.concat(F.lit("https://"), host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def opaque(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """(record_id, canonical, ts, state, source_id, headers, payload_digest) of each revisit record of read_records().

    As-of join: the latest response with status 200 of the same canonical URL with ts before the revisit's (of equal times, the
    larger record id). Validators: entity tags, compared weakly, if both have one; else Last-Modified; else the payload digests; the state is
    'resolved', 'mismatch', 'unverified' (no validator in common) or 'no response'. A resolved revisit gets the response's headers
    with those of its own that PERMITTED allows, the response's id and its digest; payloads are not moved, they are found by that id.
    A revisit whose profile is another one than that of not-modified answers (identical payload digest) recorded a full answer, so it is held
    against the payload digest alone and keeps its own headers; a record without a profile counts as not modified.

    Captures are sorted by (URL, time) over range partitions, so that one URL with very many captures spans several tasks; what an earlier
    partition knew last about a partition's first URL is one row a partition. Null URLs and times are 'no response'; repeated records are
    resolved each."""
    tables = Tables(captures.sparkSession, "revisits")
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = captures.select(canonical_url(F.col("url")).alias("canonical"), "ts", "record_id", F.coalesce(F.col("profile").endswith("server-not-modified"), F.lit(True)).alias("unmodified"), "headers", "payload_digest", (F.col("kind") == "response").alias("full"), F.coalesce(F.col("status") == 200, F.lit(False)).alias("ok"))
    rows = rows.where("not full or (ok and ts is not null and canonical is not null)")
    source = F.struct("record_id", "headers", "payload_digest")
    rows = rows.select("canonical", "ts", "record_id", "unmodified", "headers", "payload_digest", "full", F.when(F.col("full"), source).alias("source"))
    # at equal times revisits come first: a response counts only for later ones
    rows = rows.repartitionByRange(parts, "canonical", "ts", "full", "record_id").withColumn("part", F.spark_partition_id())
    rows = tables.put("sorted", rows)
    order = Window.partitionBy("part", "canonical").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("found", F.last("source", ignorenulls=True).over(order)).where("not full")
    edges = rows.groupBy("canonical").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    ends = rows.join(F.broadcast(edges.select("canonical")), "canonical", "left_semi")  # URLs that span partitions: fewer than there are partitions
    ends = ends.where("full").groupBy("canonical", "part").agg(F.max_by("source", F.struct("ts", "record_id")).alias("last"))
    carried = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = edges.select("canonical", F.explode(F.sequence("low", "high")).alias("part")).join(ends, ["canonical", "part"], "left").withColumn("before", F.last("last", ignorenulls=True).over(carried)).select("canonical", "part", "before")
    got = near.join(F.broadcast(spans), ["canonical", "part"], "left").withColumn("found", F.when(F.col("ts").isNotNull(), F.coalesce("found", "before")))
    tag, there = F.col("headers")["etag"], F.col("found.headers")["etag"]
    since, then = F.col("headers")["last-modified"], F.col("found.headers")["last-modified"]
    body = F.col("payload_digest") == F.col("found.payload_digest")
    same = F.when(F.col("unmodified"), F.coalesce(opaque(tag) == opaque(there), since == then, body)).otherwise(body)
    state = F.when(F.col("found").isNull(), "no response").when(same, "resolved").when(~same, "mismatch").otherwise("unverified")
    got = got.withColumn("state", state)
    fresh = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    kept = F.map_filter("found.headers", lambda k, _: ~F.map_contains_key(fresh, k))
    won = F.col("state") == "resolved"
    merged = F.when(F.col("unmodified"), F.map_concat(kept, fresh)).otherwise(F.col("headers"))
    return got.select("record_id", "canonical", "ts", "state", F.when(won, F.col("found.record_id")).alias("source_id"), F.when(won, merged).alias("headers"), F.when(won, F.col("found.payload_digest")).alias("payload_digest"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """WARC bytes for a table of pages (page_id, url, html), four captures a page. At its own URL a page p is captured in full at second 2p, and asked
    for again a second later with a not-modified answer; entity tags are MD5 digests of the html; where p leaves 3 modulo 7 the revisit has
    another tag, where 5 none and no Last-Modified.

    The others are of URLs that pages share (an eighth of the pages one URL, of the rest six each), written in three ways that are canonically
    one, at crossing times: a response at 3 (7919 p mod 100003), not where p leaves 4 modulo 5, with status 503 where 10 modulo 11, with
    the digest of the html as payload, with Last-Modified and, unless p leaves 2 modulo 3, an entity tag of the parity of p; and a revisit at
    3 (104729 p + 13 mod 100003) + 1, with that tag unless p leaves 1 modulo 4, with Last-Modified unless 5 modulo 13, and where 16 modulo 17 with the other
    profile and a payload digest. So a revisit's source is another page's capture, or there is none yet."""

    def record(kind: str, name: str, url: str, at: int, more: str, block: bytes) -> bytes:
        import datetime

        date = datetime.datetime.fromtimestamp(at, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n{more}Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    def own(page: int, url: str, body: bytes, digest: str) -> list[bytes]:
        tag = f'"{digest}"'
        full = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\nDate: d{2 * page}\r\nETag: {tag}\r\n\r\n".encode() + body
        mine = "" if page % 7 == 5 else f"ETag: W/{tag}\r\n" if page % 7 != 3 else 'ETag: "other"\r\n'
        again = f"HTTP/1.1 304 Not Modified\r\nDate: d{2 * page + 1}\r\nContent-Length: 0\r\nCache-Control: max-age=60\r\n{mine}\r\n".encode()
        return [record("response", f"urn:page:{page}", url, 2 * page, "", full), record("revisit", f"urn:revisit:{page}", url, 2 * page + 1, f"WARC-Profile: {NOT_MODIFIED}\r\n", again)]

    def shared(page: int, digest: str) -> list[bytes]:
        name = "hot" if page % 8 == 0 else str(page // 6)
        url = ["http://www.Set.example:80/s/{}/", "https://set.example/s/{}?utm_source=x", "https://SET.example/s/{}#top"][page % 3].format(name)
        since, tag = f"Last-Modified: m{page % 2}\r\n", f'ETag: "{name}-{page % 2}"\r\n'
        out = []
        if page % 5 != 4:
            status = "503 Unavailable" if page % 11 == 10 else "200 OK"
            block = f"HTTP/1.1 {status}\r\nContent-Type: text/plain\r\n{since}{tag if page % 3 != 2 else ''}\r\n{digest}".encode()
            out.append(record("response", f"urn:shared:{page}", url, 3 * (page * 7919 % 100003), "", block))
        other = page % 17 == 16
        more = f"WARC-Profile: {SAME_PAYLOAD if other else NOT_MODIFIED}\r\n" + (f"WARC-Payload-Digest: sha256:{hashlib.sha256(digest.encode()).hexdigest()}\r\n" if other else "")
        block = f"HTTP/1.1 304 Not Modified\r\nDate: s{page}\r\nX-Own: 1\r\n{tag if page % 4 != 1 else ''}{since if page % 13 != 5 else ''}\r\n".encode()
        return [*out, record("revisit", f"urn:again:{page}", url, 3 * ((page * 104729 + 13) % 100003) + 1, more, block)]

    def run(batches):
        for b in batches:
            out = []
            for page, url, html in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if page is None or url is None:
                    out.append(None)
                    continue
                body = (html or "").encode()
                digest = hashlib.md5(body).hexdigest()
                out.append(b"".join([*own(page, url, body, digest), *shared(page, digest)]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["warc"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "warc binary")


def revisits_of_pages(pages: DataFrame) -> DataFrame:
    """(record_id, canonical, state, source_id, merged, payload_digest): the resolved revisits of archive_pages(), merged being the
    headers in the order of their names. Pages with a null id or URL have no captures; a repeated page is archived each time."""
    tables = Tables(pages.sparkSession, "captures")
    captures = tables.put("captures", read_records(archive_pages(pages)).drop("payload"))  # written once: the range partitioning reads it twice
    got = resolve_revisits(captures)
    names = F.array_sort(F.map_keys("headers"))
    merged = F.array_join(F.transform(names, lambda k: F.concat(k, F.lit(": "), F.element_at("headers", k))), "\n")
    return got.select("record_id", "canonical", "state", "source_id", merged.alias("merged"), "payload_digest")


#: The same rows in DuckDB: all captures as rows, the source by a window over each URL's captures in their order.
ORACLE = r"""
WITH p AS (SELECT page_id::BIGINT AS p, coalesce(html, '') AS html, md5(coalesce(html, '')) AS digest, regexp_replace(url, '#.*$', '') AS u FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL),
q AS (SELECT p, html, digest, CASE WHEN p % 8 = 0 THEN 'hot' ELSE (p // 6)::VARCHAR END AS name,
  regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
  regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) AS args FROM p),
c AS (SELECT p, html, digest, name, 'https://' || host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS own, 'https://set.example/s/' || name AS shared FROM q),
e AS (
  SELECT 'urn:page:' || p AS id, p, own AS canonical, 2 * p AS ts, true AS f, digest AS tag, NULL AS since, 'sha256:' || sha256(html) AS body, strlen(html) AS size, false AS other FROM c
  UNION ALL SELECT 'urn:revisit:' || p, p, own, 2 * p + 1, false, CASE WHEN p % 7 = 5 THEN NULL WHEN p % 7 = 3 THEN 'other' ELSE digest END, NULL, NULL, NULL, false FROM c
  UNION ALL SELECT 'urn:shared:' || p, p, shared, 3 * (p * 7919 % 100003), true, CASE WHEN p % 3 <> 2 THEN name || '-' || (p % 2) END, 'm' || (p % 2), 'sha256:' || sha256(digest), NULL, false FROM c WHERE p % 5 <> 4 AND p % 11 <> 10
  UNION ALL SELECT 'urn:again:' || p, p, shared, 3 * ((p * 104729 + 13) % 100003) + 1, false, CASE WHEN p % 4 <> 1 THEN name || '-' || (p % 2) END, CASE WHEN p % 13 <> 5 THEN 'm' || (p % 2) END, CASE WHEN p % 17 = 16 THEN 'sha256:' || sha256(digest) END, NULL, p % 17 = 16 FROM c),
w AS (SELECT *, last_value(CASE WHEN f THEN {'id': id, 'tag': tag, 'since': since, 'body': body, 'size': size, 'p': p} END IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY ts, f, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM e),
t AS (SELECT *, CASE WHEN other THEN body = s.body ELSE coalesce(tag = s.tag, since = s.since, body = s.body) END AS same FROM w WHERE NOT f),
r AS (SELECT *, CASE WHEN s IS NULL THEN 'no response' WHEN same THEN 'resolved' WHEN same IS NULL THEN 'unverified' ELSE 'mismatch' END AS state FROM t)
SELECT id AS record_id, canonical, state, CASE WHEN state = 'resolved' THEN s.id END AS source_id,
  CASE WHEN state <> 'resolved' THEN NULL
    WHEN other THEN 'date: s' || p || coalesce(chr(10) || 'etag: "' || tag || '"', '') || coalesce(chr(10) || 'last-modified: ' || since, '') || chr(10) || 'x-own: 1'
    WHEN s.size IS NOT NULL THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || s.size || chr(10) || 'content-type: text/html' || chr(10) || 'date: d' || (2 * p + 1) || chr(10) || 'etag: W/"' || tag || '"'
    ELSE 'content-type: text/plain' || chr(10) || 'date: s' || p || coalesce(chr(10) || 'etag: "' || coalesce(tag, s.tag) || '"', '') || chr(10) || 'last-modified: ' || s.since END AS merged,
  CASE WHEN state = 'resolved' THEN s.body END AS payload_digest FROM r
"""
