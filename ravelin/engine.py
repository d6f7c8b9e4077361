"""The engine: requests in, lazily evaluated DataFrames out."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.errors import QueryError, bad, unsupported
from ravelin.operators import apply as pipeline
from ravelin.operators.expand import compute, expand, ordering, selected
from ravelin.operators.frame import Context, Frame, c, literal
from ravelin.operators.search import matches
from ravelin.operators.temporal import in_time
from ravelin.plans.logical import explain
from ravelin.plans.parser import parse_apply, parse_options, parse_request
from ravelin.plans.tree import Literal, Options, Request, Segment
from ravelin.sources.model import EntityModel


@dataclass
class Page:
    rows: DataFrame
    count: int | None
    next_link: str | None


class Engine:
    """Answers requests over one entity model."""

    def __init__(self, spark: SparkSession, model: EntityModel, now: str | None = None):
        self.spark, self.model = spark, model
        self.now = Literal(now, "datetime") if now else None
        self.jobs = ThreadPoolExecutor(4)

    def context(self, options: Options = Options()) -> Context:  # noqa: B008  frozen
        return Context(self.spark, self.model, dict(options.aliases), self.now)

    # --- entry points ---

    def query(self, url: str) -> DataFrame:
        """The rows that a GET of ``url`` answers with."""
        request = parse_request(url)
        frame, tail = self.walk(request)
        if tail == "$count":
            return self.filtered(frame, request.options).df.agg(F.count("*").alias("count"))
        if tail == "$ref":
            done = self.read(frame, request.options)
            return self.references(done)
        if tail is not None:
            return frame.df.select(c(tail).alias("value")).where(F.col("value").isNotNull())
        return self.read(frame, request.options).result()

    def apply(self, entity_set: str, text: str) -> DataFrame:
        options = Options(apply=parse_apply(text))
        return self.read(self.frame(entity_set, options), options).result()

    def frame(self, entity_set: str, options: Options = Options()) -> Frame:  # noqa: B008
        return Frame.of(self.context(options), self.model.set(entity_set))

    def over(self, df: DataFrame, entity_set: str, options: str = "") -> DataFrame:
        """Options over rows that are given, not read (results of operations and writes)."""
        parsed = parse_options(options)
        return self.read(Frame.of(self.context(parsed), self.model.set(entity_set), df), parsed).result()

    def explain(self, url: str) -> str:
        return explain(parse_request(url))

    def count(self, url: str) -> int:
        """The number that ``$count=true`` adds: after filters, before paging."""
        request = parse_request(url)
        frame, _ = self.walk(request)
        return self.filtered(frame, request.options).df.count()

    def service_document(self) -> DataFrame:
        return self.spark.createDataFrame([(n, "EntitySet", n) for n in sorted(self.model.sets)], "name string, kind string, url string")

    # --- resource paths ---

    def walk(self, request: Request) -> tuple[Frame, str | None]:
        """The frame that a path leads to, and a property, $count or $ref at its end."""
        if not request.segments:
            raise QueryError(404, "the path is empty")
        first, *rest = request.segments
        if first.name in self.model.functions and first.name not in self.model.sets:
            found = self.model.functions[first.name](self, **{k: v.value for k, v in first.keys or ()})  # type: ignore[union-attr]
            frame = found if isinstance(found, Frame) else Frame(self.context(request.options), found, None, list(found.columns))
        else:
            frame = self.keyed(self.frame(first.name, request.options), first.keys)
        single = first.keys is not None
        for i, s in enumerate(rest):
            entity = frame.set
            if s.name == "$filter":
                condition = frame.condition(s.filter)  # type: ignore[arg-type]
                frame = frame.with_df(frame.df.filter(condition))
            elif s.name in ("$count", "$ref", "$each"):
                return frame, s.name if s.name != "$each" else None
            elif s.name == "$value" and i:
                return frame, rest[i - 1].name
            elif "." in s.name and entity is not None and s.keys is None:
                if s.name in self.model.functions:
                    found = self.model.functions[s.name](self, frame)
                    frame = found if isinstance(found, Frame) else Frame(frame.ctx, found, None, list(found.columns))
                else:
                    frame = frame.with_df(frame.df.filter(frame._is_type("", s.name)))
            elif s.name in self.model.functions:
                found = self.model.functions[s.name](self, frame, **{k: v.value for k, v in s.keys or ()})  # type: ignore[union-attr]
                frame = found if isinstance(found, Frame) else Frame(frame.ctx, found, None, list(found.columns))
            elif entity is not None and entity.nav(s.name):
                nav = entity.nav(s.name)
                member, remote = frame.members(nav, None)  # type: ignore[arg-type]
                owner = frame.df.select(*[c(a).alias(f"__own{k}") for k, (a, _) in enumerate(nav.on)]).distinct()  # type: ignore[union-attr]
                condition = F.lit(True)
                for k, r in enumerate(remote):
                    condition &= c(r) == c(f"__own{k}")
                rows = member.df.join(owner, condition, "left_semi")
                frame = self.keyed(Frame.of(frame.ctx, self.model.set(nav.target), rows.select(*[c(x) for x in member.shape])), s.keys)  # type: ignore[union-attr]
                single = not nav.many or s.keys is not None  # type: ignore[union-attr]
            elif entity is not None and s.name in frame.shape:
                if rest[i + 1 :] and rest[i + 1].name != "$value":
                    raise bad(f"{s.name} has no properties")
                return frame, s.name
            elif not single and entity is not None and len(entity.key) == 1 and s.keys is None:
                frame = self.keyed(frame, (("", Literal(self._segment_key(frame, s), "string")),))
                single = True
            else:
                raise QueryError(404, f"no resource {s.name}")
        return frame, None

    def _segment_key(self, frame: Frame, s: Segment) -> str:
        return s.name.strip("'")

    def keyed(self, frame: Frame, keys: tuple | None) -> Frame:
        if keys is None:
            return frame
        entity = frame.set
        assert entity is not None
        names = dict(keys)
        if set(names) == {""} and len(entity.key) == 1:
            names = {entity.key[0]: names[""]}
        if set(names) != set(entity.key):
            raise QueryError(404, f"{entity.name} has the key {', '.join(entity.key)}")
        condition = F.lit(True)
        for k, v in names.items():
            v = frame.plain(v)
            if not isinstance(v, Literal):
                raise bad("a key must be a literal")
            if v.kind == "null":
                raise bad("a key can't be null")
            kind = frame.df.schema[k].dataType.simpleString()
            if kind in ("int", "bigint", "smallint", "tinyint") and not str(v.value).lstrip("-").isdigit():
                raise QueryError(404, f"no {entity.name} with the key {v.value}")
            value = literal(v, kind) if v.kind in ("date", "datetime") else F.lit(str(v.value)).cast(kind)
            condition &= c(k) == value
        return frame.with_df(frame.df.filter(condition))

    # --- options ---

    def filtered(self, frame: Frame, options: Options) -> Frame:
        """Time, search, $apply, computed names and $filter: what counts."""
        frame = frame.copy(these=frame.df)
        time = in_time(frame, options)
        if time is not None:
            frame.df = frame.df.filter(time)
        if options.apply:
            if options.search is not None:
                frame.df = frame.df.filter(matches(frame, options.search))
            frame = pipeline.run(frame, options.apply)
            frame = frame.copy(these=frame.df, done={})
        elif options.search is not None:
            frame.df = frame.df.filter(matches(frame, options.search))
        compute(frame, options)
        if options.filter is not None:
            condition = frame.condition(options.filter)
            frame.df = frame.df.filter(condition)
        return frame

    def read(self, frame: Frame, options: Options) -> Frame:
        """All options in order: filters, order, paging, expansion, selection."""
        if options.levels is not None:
            raise bad("$levels outside of $expand")
        frame = self.filtered(frame, options)
        if options.expand and frame.set is None:
            raise bad("$expand on grouped rows")
        paged = options.top is not None or options.skip or options.skiptoken is not None
        order: list[Column] = []
        if options.orderby or paged:
            frame.these = frame.df
            order = ordering(frame, options) if options.orderby or not frame.order else [pipeline.sort(x, d) for x, d in frame.order]
        if options.skiptoken is not None:
            frame = frame.with_df(frame.df.filter(self.after(frame, options.skiptoken)))
        if order:
            frame.df = frame.df.orderBy(*order)
            if options.skip:
                frame.df = frame.df.offset(options.skip)
            if options.top is not None:
                frame.df = frame.df.limit(options.top)
        frame = expand(frame, options.expand)
        frame.shape = selected(frame, options.select)
        return frame

    def after(self, frame: Frame, token: str) -> Column:
        """Rows behind a key: ``(k1 > v1) or (k1 = v1 and k2 > v2) ...``."""
        if frame.set is None or not frame.set.key:
            raise bad("a key token on rows without a key")
        values = token.split(",")
        if len(values) != len(frame.set.key):
            raise bad("the token does not fit the key")
        condition, same = F.lit(False), F.lit(True)
        for k, v in zip(frame.set.key, values, strict=True):
            value = F.lit(v.strip("'")).cast(frame.df.schema[k].dataType)
            condition |= same & (c(k) > value)
            same &= c(k) == value
        return condition

    def page(self, url: str, size: int, max_bytes: int | None = None) -> Page:
        """One page of at most ``size`` rows (and about ``max_bytes``, one row at least), with the link to the next."""
        request = parse_request(url)
        o = request.options
        base, _, query = url.partition("?")
        frame, _ = self.walk(request)
        count = self.filtered(frame, o).df.count() if o.count else None
        by_key = not o.orderby and not o.apply and frame.set is not None and bool(frame.set.key)
        limit = size if o.top is None else min(size, o.top)
        done = self.read(frame, replace(o, top=limit + 1 if o.top is None or o.top > limit else limit, orderby=o.orderby))
        shown = done.result(list(dict.fromkeys([*done.shape, *(frame.set.key if by_key else ())])))  # type: ignore[union-attr]
        schema = shown.schema
        if max_bytes is not None:  # of a row as it is served
            shown = shown.withColumn("__bytes", F.octet_length(F.to_json(F.struct(*[c(x) for x in done.shape]), {"ignoreNullFields": "false"})))
        rows = shown.collect()  # one page
        more = len(rows) > limit
        kept = rows[:limit]
        if max_bytes is not None:
            total, n = 0, 0
            for r in kept:
                total += r["__bytes"] or 0
                if n and total > max_bytes:
                    break
                n += 1
            more, kept = more or n < len(kept), [r[:-1] for r in kept[:n]]
        df = self.spark.createDataFrame(kept, schema).select(*[c(x) for x in done.shape])
        link = None
        if more and kept:
            rest = [p for p in query.split("&") if p and not p.startswith(("$skiptoken", "$skip=", "$top="))]
            left = [] if o.top is None else [f"$top={o.top - len(kept)}"]
            if by_key:
                token = ",".join(str(kept[-1][schema.names.index(k)]) for k in frame.set.key)  # type: ignore[union-attr]
                link = f"{base}?{'&'.join([*rest, *left, f'$skiptoken={token}'])}"
            else:
                link = f"{base}?{'&'.join([*rest, *left, f'$skip={(o.skip or 0) + len(kept)}'])}"
        return Page(df, count, link)

    def references(self, frame: Frame) -> DataFrame:
        entity = frame.set
        if entity is None or not entity.key:
            raise unsupported("references of rows without a key")
        quoted = [F.concat(F.lit("'"), c(k), F.lit("'")) if frame.df.schema[k].dataType.simpleString() == "string" else c(k).cast("string") for k in entity.key]
        parts = quoted if len(quoted) == 1 else [F.concat(F.lit(f"{k}="), q) for k, q in zip(entity.key, quoted, strict=True)]
        return frame.df.select(F.concat(F.lit(f"{entity.name}("), F.concat_ws(",", *parts), F.lit(")")).alias("id"))

    # --- sinks ---

    def json(self, url: str) -> DataFrame:
        """Rows as JSON texts, null values kept."""
        df = self.query(url)
        return df.select(F.to_json(F.struct(*[c(x) for x in df.columns]), {"ignoreNullFields": "false"}).alias("value"))

    def document(self, url: str, size: int = 1000, metadata: str = "minimal") -> dict:
        """The response envelope of a collection: context, count, next link and one page of rows.

        ``metadata``: ``none`` leaves the context out, ``full`` gives each row its id.
        """
        if metadata not in ("none", "minimal", "full"):
            raise bad(f"no metadata level {metadata}")
        page = self.page(url, size)
        request = parse_request(url)
        frame, _ = self.walk(request)
        out: dict = {}
        if metadata != "none":
            chosen = f"({','.join(request.options.select)})" if request.options.select else ""
            out["@odata.context"] = f"$metadata#{frame.set.name if frame.set is not None else request.segments[0].name}{chosen}"
        if page.count is not None:
            out["@odata.count"] = page.count
        out["value"] = [json.loads(r[0]) for r in page.rows.select(F.to_json(F.struct(*[c(x) for x in page.rows.columns]), {"ignoreNullFields": "false"})).collect()]  # one page
        if metadata == "full" and frame.set is not None:
            for row in out["value"]:
                if all(k in row for k in frame.set.key):
                    keys = [f"'{row[k]}'" if isinstance(row[k], str) else str(row[k]) for k in frame.set.key]
                    row["@odata.id"] = f"{frame.set.name}({keys[0] if len(keys) == 1 else ','.join(f'{k}={v}' for k, v in zip(frame.set.key, keys, strict=True))})"
        if page.next_link:
            out["@odata.nextLink"] = page.next_link
        return out

    def stream_of(self, url: str) -> DataFrame:
        """Bytes, content type and a tag of a media entity."""
        frame, _ = self.walk(parse_request(url))
        if frame.set is None or frame.set.stream is None:
            raise QueryError(404, "no stream")
        data, kind = frame.set.stream
        return frame.df.select(c(data).alias("content"), c(kind).alias("content_type"), F.sha2(c(data), 256).alias("etag"))

    # --- batches and jobs ---

    def submit(self, url: str) -> Future:
        """A request that runs on its own; its result is the list of rows."""
        return self.jobs.submit(lambda: self.query(url).collect())

    def batch(self, requests: list[str | Callable[[Engine], DataFrame]]) -> list[DataFrame | QueryError]:
        """Answers of several requests; a request that fails answers with its error."""
        if len(requests) > 100:
            raise bad("too many requests in the batch")
        out: list[DataFrame | QueryError] = []
        for r in requests:
            try:
                out.append(self.query(r) if isinstance(r, str) else r(self))
            except QueryError as e:
                out.append(e)
        return out

    def batch_document(self, requests: list[dict], store=None) -> list[dict]:
        """The JSON form of a batch: ``{"id", "method", "url", "dependsOn", "atomicityGroup", "write"}``.

        A URL that begins with ``$id`` goes on from that request's resource. A
        request fails (424) with those that it depends on. Requests of one group
        are writes (``write`` takes the store): all of them happen or none.
        """
        if len(requests) > 100:
            raise bad("too many requests in the batch")
        status: dict[str, int] = {}
        urls: dict[str, str] = {}
        out: list[dict] = []
        groups: dict[str, list[dict]] = {}
        for r in requests:
            if r.get("atomicityGroup"):
                groups.setdefault(r["atomicityGroup"], []).append(r)
        for r in requests:
            group = r.get("atomicityGroup")
            if group and r["id"] in status:
                continue
            if any(status.get(d, 424) >= 400 for d in r.get("dependsOn", ())):
                status[r["id"]] = 424
                out.append({"id": r["id"], "status": 424})
                continue
            try:
                if group:
                    if store is None:
                        raise bad("writes need a store")
                    store.change_set([x["write"] for x in groups[group]])
                    answers = [{"id": x["id"], "status": 204} for x in groups[group]]
                else:
                    head, slash, rest = r["url"].partition("/")
                    url = urls[head[1:]].partition("?")[0] + slash + rest if head.startswith("$") and head[1:] in urls else r["url"]
                    urls[r["id"]] = url
                    answers = [{"id": r["id"], "status": 200, "rows": self.query(url)}]
            except QueryError as e:
                answers = [{"id": x["id"], "status": e.status} for x in (groups[group] if group else [r])]
            for a in answers:
                status[a["id"]] = a["status"]
            out += answers
        return out
