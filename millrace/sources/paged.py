"""Paged endpoints as a Spark data source: ``spark.read.format("paged_api")``, one row per object.

Offset paging knows its pages beforehand and reads each range in a task of its own; token paging follows the tokens in
one task, as each is only known from the page before. Every page has its own retries: a wait that the server names
goes before the schedule, and a page that stays refused fails the read, so that it never comes back short.

As a stream, its offset is the cursor: a micro-batch has the objects that changed after the cursor of the one before, up
to its own, which Spark keeps in the checkpoint. So a restart reads on from there, and a batch that failed is read again
between the same two times.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from millrace.functions.retry import OUTAGE, REFUSED, UNRECORDED, Patience, SourceFailure, answer

Transport = Callable[[str, dict[str, str]], tuple[int, dict[str, str], dict]]
MAX_PAGE = 100


class Recorded:
    """Answers requests from recorded exchanges: the first unused one of the path whose parameters the request all has."""

    def __init__(self, exchanges: list[dict]) -> None:
        self.left = list(exchanges)

    def __call__(self, path: str, params: dict[str, str]) -> tuple[int, dict[str, str], dict]:
        for i, e in enumerate(self.left):
            if e["path"] == path and all(params.get(str(k)) == str(v) for k, v in (e.get("params") or {}).items()):
                del self.left[i]
                return int(e.get("status", 200)), dict(e.get("headers") or {}), dict(e.get("body") or {})
        raise SourceFailure(UNRECORDED, f"nothing recorded for {path} with {params}")


class Live:
    """Asks a server by HTTP, with the token that an environment variable of the executor holds."""

    def __init__(self, base_url: str, token_variable: str = "CRM_API_TOKEN", timeout: float = 30.0) -> None:
        self.base_url, self.token_variable, self.timeout = base_url.rstrip("/"), token_variable, timeout

    def __call__(self, path: str, params: dict[str, str]) -> tuple[int, dict[str, str], dict]:
        request = urllib.request.Request(f"{self.base_url}{path}?{urllib.parse.urlencode(params)}")
        request.add_header("Authorization", f"Bearer {os.environ.get(self.token_variable, '')}")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as found:
                return found.status, dict(found.headers), json.loads(found.read() or b"{}")
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers or {}), {"message": e.reason}
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:  # the latter two also while the answer is read
            raise SourceFailure(OUTAGE, f"{path}: {getattr(e, 'reason', e)}") from e


def token_pages(get: Callable[[dict[str, str]], dict], params: dict[str, str]) -> Iterator[dict]:
    """Pages up to the one that names no next; an empty page does not end them, and a token that comes again is an error."""
    after, seen = None, set()
    while True:
        page = get(params if after is None else params | {"after": after})
        yield page
        paging = page.get("paging")
        follows = paging.get("next") if isinstance(paging, dict) else None
        after = follows.get("after") if isinstance(follows, dict) else None
        if after in (None, ""):
            return
        after = str(after)
        if after in seen:
            raise SourceFailure(REFUSED, f"page token {after!r} came twice", status=200)
        seen.add(after)


class _Range(InputPartition):
    def __init__(self, first: int, until: int | None) -> None:
        super().__init__((first, until))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.params = o.get("path", "/"), dict(json.loads(o.get("params", "{}")))
        self.rows, self.offset = o.get("rows", "results"), o.get("paging", "token") == "offset"
        self.page = int(o.get("pagesize", MAX_PAGE))
        if not 1 <= self.page <= MAX_PAGE:
            raise ValueError(f"pageSize must be 1..{MAX_PAGE}, got {self.page}")
        self.patience = Patience(tries=int(o.get("attempts", 4)), first=float(o.get("base", 0.5)))
        self.recorded, self.url = o.get("exchanges"), o.get("url")
        self.tasks, self.waits = int(o.get("tasks", 8)), o.get("waits", "true") == "true"

    def _get(self) -> Callable[[dict[str, str]], dict]:
        transport: Transport = Recorded(json.loads(self.recorded)) if self.recorded is not None else Live(self.url)
        pause = time.sleep if self.waits else lambda _: None
        return lambda params: self.patience.fetch(lambda: answer(self.path, *transport(self.path, params)), pause)

    def partitions(self) -> list[InputPartition]:
        if not self.offset:
            return [_Range(0, None)]
        total = int(self._get()(self.params | {"startAt": "0", "maxResults": str(self.page)}).get("total") or 0)
        pages = -(-total // self.page)
        each = max(1, -(-pages // self.tasks)) * self.page
        return [_Range(at, min(at + each, total)) for at in range(0, total, each)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int]]:
        first, until = partition.value
        get = self._get()
        if self.offset:
            pages = (get(self.params | {"startAt": str(at), "maxResults": str(self.page)}) for at in range(first, until, self.page))
        else:
            pages = token_pages(get, self.params | {"limit": str(self.page)})
        for number, row in enumerate((row for page in pages for row in page.get(self.rows) or []), first):
            yield json.dumps(row), number


def _instant(text: object) -> datetime | None:
    """The instant of an ISO 8601 text, UTC where it names no offset; None for anything else."""
    try:
        found = datetime.fromisoformat(str(text).strip())
    except ValueError:
        return None
    return found.replace(tzinfo=UTC) if found.tzinfo is None else found.astimezone(UTC)


def changed_at(row: dict, times: list[str]) -> datetime | None:
    """When an object says it changed: the first of the dotted names that holds anything."""
    for name in times:
        value: object = row
        for part in name.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if value:
            return _instant(value)
    return None


class _Span(InputPartition):
    def __init__(self, after: str | None, until: str, first: int, last: int | None) -> None:
        super().__init__((after, until, first, last))


class _StreamReader(_Reader, DataSourceStreamReader):
    """Offsets: {"cursor": an instant, or null before the first}."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        o = {k.lower(): v for k, v in options.items()}
        self.times, self.asks = [t for t in o.get("times", "").split(",") if t], o.get("asks")
        self.since, self.until, self.lag = o.get("since"), o.get("until"), float(o.get("lag", 60))
        if not self.times:
            raise ValueError("a stream needs times, the names of what says when an object changed")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": self.since}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"cursor": (_instant(self.until) if self.until else datetime.now(UTC) - timedelta(seconds=self.lag)).isoformat()}

    def _asked(self, after: str | None) -> dict[str, str]:
        return {self.asks: after} if self.asks and after else {}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        asked, self.params = self.params, self.params | self._asked(start["cursor"])
        try:
            return [_Span(start["cursor"], end["cursor"], *p.value) for p in super().partitions()]
        finally:
            self.params = asked

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int]]:
        after, until, first, last = partition.value
        asked, self.params = self.params, self.params | self._asked(after)
        try:
            for text, number in super().read(_Range(first, last)):
                at = changed_at(json.loads(text), self.times)
                if at is None or (after is None or at > _instant(after)) and at <= _instant(until):
                    yield text, number
        finally:
            self.params = asked


class PagedApi(DataSource):
    """Options: path, params (JSON), paging (token or offset), rows (the page's list), pageSize, attempts, base, tasks, waits, and url or exchanges (JSON).

    waits=false skips the waits between retries of a recording. A stream also has times (dotted names of what says when an object
    changed, by commas), asks (the parameter that tells the server the cursor, if it takes one), since (the first cursor), until
    (the last one; else it is the time of the batch less ``lag`` seconds, 60, for objects that are listed late). Objects that do not say
    when they changed come in every batch.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        return "value string, arrival long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)


def objects(
    spark: SparkSession, path: str, *, properties: tuple[str, ...] = (), associations: tuple[str, ...] = (), asked: dict[str, str] | None = None, stream: bool = False, **options: str
) -> DataFrame:
    """The rows of an endpoint, each as JSON text in value, with its place in the list as arrival; as a stream if told. asked: further parameters of each request."""
    spark.dataSource.register(PagedApi)
    params = dict(asked or {})
    params |= {"properties": ",".join(properties)} if properties else {}
    params |= {"associations": ",".join(associations)} if associations else {}
    return (spark.readStream if stream else spark.read).format("paged_api").options(path=path, params=json.dumps(params), **options).load()


def endpoint(spark: SparkSession, url: str | None = None, recordings: tuple[str, ...] = (), **options: str) -> dict[str, str]:
    """The options of a server, or of recordings of one in place of it: everything else of a read is the same."""
    if (url is None) == (not recordings):
        raise ValueError("either the url of a server or recordings")
    return options | ({"url": url} if url is not None else {"exchanges": exchanges_of(spark, *recordings), "waits": "false"})


def exchanges_of(spark: SparkSession, *paths: str) -> str:
    """The exchanges of recordings, one after the other, as the option's text."""
    texts = [spark.read.text(p, wholetext=True).first()["value"] for p in paths]
    return json.dumps([e for t in texts for e in json.loads(t)["exchanges"]])


def recording(rows: list[dict], path: str, *, page: int, rows_key: str = "issues", drifts_from: int | None = None, drift: Callable[[dict], dict] = dict, refusals: dict[int, float] | None = None) -> list[dict]:
    """Exchanges of an offset-paged endpoint that serves a few rows, as a stand-in for a server.

    From page ``drifts_from`` on, rows come as ``drift`` makes them; a page of ``refusals`` is refused once, with that wait.
    """
    out: list[dict] = []
    for number, at in enumerate(range(0, max(len(rows), 1), page)):
        params = {"startAt": str(at)}
        drifted = drifts_from is not None and number >= drifts_from
        if number in (refusals or {}):
            out.append({"path": path, "params": params, "status": 429, "headers": {"Retry-After": str(refusals[number])}, "body": {"message": "quota"}})
        body = {"startAt": at, "total": len(rows), rows_key: [drift(r) if drifted else r for r in rows[at : at + page]]}
        out += [{"path": path, "params": params, "status": 200, "body": body}] * (2 if at == 0 else 1)  # the first page is asked for its total, too
    return out
