"""Paged JSON resources as a Spark data source.

``spark.read.format("skein_pages").option("path", ..)`` reads pages that were dumped as files (one JSON list a file, one
partition a file) or, with option ``url``, follows Link headers of a live service (one partition a resource, since each
page names the next). Rows are (page, raw).
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from urllib.parse import parse_qs, quote, urlencode, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.sources.retry import rate_limit_wait

PAGE_SIZE = 100
Reply = tuple[int, dict[str, str], bytes]


def links(header: str) -> dict[str, str]:
    """Targets (path and query) of a Link header by relation."""
    out = {}
    for part in header.split(","):
        sections = [s.strip() for s in part.split(";")]
        if len(sections) > 1 and sections[1].startswith('rel="'):
            url = urlparse(sections[0].strip("<>"))
            out[sections[1][5:-1]] = url.path + (f"?{url.query}" if url.query else "")
    return out


def last_page(header: str) -> int:
    pages = parse_qs(urlparse(links(header).get("last", "")).query).get("page", ["0"])
    return int(pages[0]) if pages[0].isdigit() else 0


def issues_path(owner: str, repo: str, state: str = "open", since: str = "") -> str:
    query = {"state": state, "sort": "updated", "direction": "desc", "per_page": PAGE_SIZE} | ({"since": since} if since else {})
    return f"/repos/{owner}/{repo}/issues?{urlencode(query)}"


def comment_paths(owner: str, repo: str, number: int, kind: str) -> dict[str, str]:
    """Where the comments of a thread are listed, by comment type."""
    base, page = f"/repos/{owner}/{repo}", f"?per_page={PAGE_SIZE}"
    out = {"issue_comment": f"{base}/issues/{number}/comments{page}"}
    if kind == "pull_request":
        out |= {"pull_review": f"{base}/pulls/{number}/reviews{page}", "pull_review_comment": f"{base}/pulls/{number}/comments{page}"}
    return out


def resource_path(owner: str, repo: str, kind: str = "", number: int = 0) -> str:
    """Of a repository, or (kind issue or pull_request) of one of its threads."""
    base = f"/repos/{quote(owner, safe='')}/{quote(repo, safe='')}"
    return f"{base}/{'pulls' if kind == 'pull_request' else 'issues'}/{number}" if kind else base


def files_path(owner: str, repo: str, number: int) -> str:
    """Where the files of a change request are listed."""
    return f"{resource_path(owner, repo, 'pull_request', number)}/files?per_page={PAGE_SIZE}"


def http_get(base: str, token: str = "") -> Callable[[str], Reply]:
    def get(path: str) -> Reply:
        request = urllib.request.Request(base.rstrip("/") + path, headers={"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}))
        try:
            with urllib.request.urlopen(request, timeout=60) as reply:
                return reply.status, dict(reply.headers), reply.read()
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), e.read()

    return get


def get_once_more(get: Callable[[str], Reply], path: str, sleep: Callable[[float], None] = time.sleep) -> Reply:
    """A reply; after a rate limit a second try."""
    status, headers, body = get(path)
    if (wait := rate_limit_wait(status, headers, datetime.now(timezone.utc))) is not None:
        sleep(wait)
        status, headers, body = get(path)
    if not 200 <= status < 300:
        raise OSError(f"{path}: status {status}")
    return status, headers, body


def pages(get: Callable[[str], Reply], path: str, limit: int = 0, sleep: Callable[[float], None] = time.sleep) -> Iterator[list]:
    """Lists of rows until there is no next page, or limit rows were given."""
    given = 0
    while path:
        _, headers, body = get_once_more(get, path, sleep)
        rows = json.loads(body)
        if limit > 0:
            rows = rows[: limit - given]
        given += len(rows)
        yield rows
        if limit > 0 and given >= limit:
            return
        path = links({k.lower(): v for k, v in headers.items()}.get("link", "")).get("next", "")


def resource(get: Callable[[str], Reply], path: str, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One object, as of resource_path."""
    return json.loads(get_once_more(get, path, sleep)[2])


def page_total(page: int, link_header: str = "", expected: int = 0, known: int = 0) -> int:
    """How many pages a listing has, as far as is known on a page of it: by the rows expected, by the header's last page,
    and not below the pages seen; 0: not known."""
    total = max(known, -(-expected // PAGE_SIZE) if expected > 0 else 0, last_page(link_header))
    return max(total, page) if total else 0


def thread_comment_rows(get: Callable[[str], Reply], owner: str, repo: str, number: int, kind: str, thread_id: int, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """(thread_id, comment_type, page, place, raw) of all kinds of comments of a thread, as ingest.thread_comments reads."""
    for comment_type, path in comment_paths(owner, repo, number, kind).items():
        for page, rows in enumerate(pages(get, path, sleep=sleep)):
            yield from ((thread_id, comment_type, page, place, json.dumps(row)) for place, row in enumerate(rows))


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skein_pages"

    def schema(self) -> str:
        return "page long, raw string"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(dict(self.options))


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        if "url" in self.options:
            return [InputPartition(r) for r in self.options["resources"].split("\n")]
        folder = self.options["path"]
        return [InputPartition(os.path.join(folder, n)) for n in sorted(os.listdir(folder)) if n.endswith(".json")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if "url" in self.options:
            for k, rows in enumerate(pages(http_get(self.options["url"], os.environ.get(self.options.get("tokenenv", ""), "")), partition.value, int(self.options.get("limit", 0)))):
                yield from ((k, json.dumps(r)) for r in rows)
            return
        with open(partition.value, encoding="utf-8") as f:
            rows = json.load(f)
        yield from ((0, json.dumps(r)) for r in (rows if isinstance(rows, list) else [rows]))
