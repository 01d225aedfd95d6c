"""Entry points: ``enrich`` a table, or build a ``Pipeline`` step by step."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowloom import store
from rowloom.functions import cost, parsing, prompt, text
from rowloom.observe import Dispatcher
from rowloom.operators import batches, grounding, invoke, merge, quality, resume, retrieval, rows, runs
from rowloom.sources import jsonl, provider, readers, writers
from rowloom.streaming import runner

Stage = Callable[[DataFrame], DataFrame]
PLACES = ("after_load", "before_prompt", "after_reply", "after_merge")
_LOG = f"session string, row_index long, version long, reply string, tokens_in long, tokens_out long, error string, cost {cost.MONEY}"


@dataclass
class Settings:
    source: Any = None
    reading: dict[str, Any] = field(default_factory=dict)
    inputs: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    key: str | None = None
    filters: dict[str, Any] = field(default_factory=dict)
    template: str = ""
    system: str | None = None
    examples: list[tuple[str, str]] = field(default_factory=list)
    context: str | None = None
    evidence: str | None = None
    clean: bool = False
    redact: bool = False
    pack: int = 1
    parser: str = "raw"
    patterns: dict[str, str] = field(default_factory=dict)
    schema: str | None = None
    model: Callable[..., Any] | None = None
    remote: bool = False
    client: dict[str, Any] = field(default_factory=dict)
    router: tuple[str, dict[str, dict[str, float]]] | None = None
    prices: tuple[str, str] = ("0", "0")
    budget: str | None = None
    waves: int = 1
    log: str | None = None
    session: str = "default"
    policy: str = "skip"
    default: str | None = None
    retries: int = 0
    guard: bool = True
    knowledge: dict[str, Any] = field(default_factory=dict)
    claims: dict[str, Any] = field(default_factory=dict)
    grounding: dict[str, Any] = field(default_factory=dict)
    contradictions: dict[str, Any] = field(default_factory=dict)
    confidence: str | None = None
    merge: str = "replace"
    out: str | None = None
    stages: list[tuple[str, Stage]] = field(default_factory=list)
    observers: list[Any] = field(default_factory=list)


@dataclass(frozen=True)
class PipelineBuilder:
    """Each method returns a new builder with one setting changed."""

    spark: SparkSession
    settings: Settings = field(default_factory=Settings)

    def _with(self, **changes: Any) -> PipelineBuilder:
        return PipelineBuilder(self.spark, replace(self.settings, **changes))

    @staticmethod
    def create(spark: SparkSession) -> PipelineBuilder:
        return PipelineBuilder(spark)

    # ------------------------------------------------------------ input
    def from_settings(self, settings: Settings) -> PipelineBuilder:
        return PipelineBuilder(self.spark, settings)

    def from_source(self, source: Any, inputs: list[str], outputs: list[str], key: str | None = None, **reading: Any) -> PipelineBuilder:
        """``key`` numbers the rows; without one they are numbered as they lie, in a copy in the shared folder."""
        return self._with(source=source, inputs=inputs, outputs=outputs, key=key, reading=reading)

    def from_csv(self, path: str, inputs: list[str], outputs: list[str], key: str | None = None, sep: str = ",", encoding: str = "UTF-8") -> PipelineBuilder:
        return self.from_source(path, inputs, outputs, key, sep=sep, encoding=encoding)

    def from_excel(self, path: str, inputs: list[str], outputs: list[str], key: str | None = None, sheet: str | int = 0) -> PipelineBuilder:
        return self.from_source(path, inputs, outputs, key, sheet=sheet)

    def from_parquet(self, path: str, inputs: list[str], outputs: list[str], key: str | None = None) -> PipelineBuilder:
        return self.from_source(path, inputs, outputs, key)

    def from_dataframe(self, df: Any, inputs: list[str], outputs: list[str], key: str | None = None) -> PipelineBuilder:
        """Of Spark, pandas or polars."""
        return self.from_source(df, inputs, outputs, key)

    def with_filters(self, **filters: Any) -> PipelineBuilder:
        return self._with(filters=filters)

    # ------------------------------------------------------------ prompt
    def with_prompt(self, template: str, examples: list[tuple[str, str]] | None = None, context: str | None = None) -> PipelineBuilder:
        return self._with(template=template, examples=examples or [], context=context or self.settings.context)

    def with_system_prompt(self, text_: str) -> PipelineBuilder:
        """What goes before every prompt of a column model; clients get it apart, through ``make(system=...)``."""
        return self._with(system=text_)

    def with_preprocessing(self, clean: bool = True, redact: bool = False) -> PipelineBuilder:
        return self._with(clean=clean, redact=redact)

    def with_batch_size(self, n: int) -> PipelineBuilder:
        if n < 1:
            raise ValueError("a batch has at least one row")
        return self._with(pack=n)

    def with_batch_strategy(self, name: str) -> PipelineBuilder:
        """``json`` is the one way to pack rows; ``csv`` is taken for it."""
        if name not in ("json", "csv"):
            raise ValueError(f"unknown batch strategy {name!r}")
        return self

    def with_parser(self, name: str, patterns: dict[str, str] | None = None, schema: str | None = None) -> PipelineBuilder:
        return self._with(parser=name, patterns=patterns or {}, schema=schema or self.settings.schema)

    def with_structured_output(self, schema: str) -> PipelineBuilder:
        """Replies are JSON objects of the DDL ``schema``; clients are asked for it."""
        return self._with(parser="schema", schema=schema)

    # ------------------------------------------------------------ model
    def with_column_model(self, model: invoke.ColumnModel) -> PipelineBuilder:
        return self._with(model=model, remote=False)

    def with_client(self, make: Callable[[], invoke.Client], **options: Any) -> PipelineBuilder:
        return self._with(model=make, remote=True, client={**self.settings.client, **options})

    def with_preset(self, name: str, make: Callable[..., invoke.Client]) -> PipelineBuilder:
        """A named model of ``provider.PRESETS``: its prices, and ``make`` told the model's name."""
        spec = provider.PRESETS[name]
        return self.with_client(lambda: make(spec.model)).with_prices(spec.price_in, spec.price_out)

    def with_concurrency(self, threads: int) -> PipelineBuilder:
        return self._with(client={**self.settings.client, "threads": threads})

    def with_adaptive_concurrency(self, on: bool = True) -> PipelineBuilder:
        return self._with(client={**self.settings.client, "adaptive": on})

    def with_rate_limit(self, rpm: float) -> PipelineBuilder:
        """Calls a minute of the whole job."""
        return self._with(client={**self.settings.client, "rpm": rpm})

    def with_max_retries(self, n: int, pause: float = 1.0) -> PipelineBuilder:
        return self._with(client={**self.settings.client, "retries": n, "pause": pause})

    def with_router(self, strategy: str, deployments: dict[str, dict[str, float]]) -> PipelineBuilder:
        """Each row goes to a deployment; ``make(deployment=...)`` builds its client."""
        runs.shares(strategy, deployments)
        return self._with(router=(strategy, deployments))

    def with_prices(self, tokens_in: str, tokens_out: str) -> PipelineBuilder:
        return self._with(prices=(tokens_in, tokens_out))

    # ------------------------------------------------------------ run
    def with_budget(self, most: str, waves: int = 10) -> PipelineBuilder:
        """Stop between waves once more than ``most`` is spent; needs a log."""
        return self._with(budget=most, waves=waves)

    def with_log(self, path: str, session: str = "default", waves: int = 1) -> PipelineBuilder:
        return self._with(log=path, session=session, waves=max(waves, self.settings.waves))

    def with_error_policy(self, policy: str, default: str | None = None) -> PipelineBuilder:
        """``skip``, ``use_default``, ``fail``, or ``retry``: two more passes over failed rows, then skip."""
        if policy == "retry":
            return self._with(policy="skip", retries=max(2, self.settings.retries))
        return self._with(policy=policy, default=default)

    def with_auto_retry(self, passes: int = 3) -> PipelineBuilder:
        """Ask again, up to ``passes`` times, for rows in which no output is valid; needs a log."""
        return self._with(retries=passes)

    def with_guard(self, on: bool = True) -> PipelineBuilder:
        return self._with(guard=on)

    def with_merge(self, how: str) -> PipelineBuilder:
        return self._with(merge=how)

    def with_stage(self, stage: Stage | str, at: str = "after_load") -> PipelineBuilder:
        if at not in PLACES:
            raise ValueError(f"a stage goes to one of {PLACES}")
        return self._with(stages=[*self.settings.stages, (at, STAGES[stage] if isinstance(stage, str) else stage)])

    def with_observer(self, observer: Any) -> PipelineBuilder:
        return self._with(observers=[*self.settings.observers, observer])

    # ------------------------------------------------------------ knowledge
    def with_knowledge_base(self, chunks: DataFrame, k: int = 5, chunk_id: str = "chunk_id", text_: str = "text", **options: Any) -> PipelineBuilder:
        """Texts that match the inputs go before the prompt, as ``_kb_context``; options are those of ``retrieval.search``."""
        return self._with(knowledge={"chunks": chunks, "k": k, "chunk_id": chunk_id, "text": text_, "options": options}, context="_kb_context")

    def with_evidence_priming(self, claims: DataFrame, k: int = 3, min_score: float = 0.1, claim_id: str = "claim", text_: str = "text", source: str | None = None) -> PipelineBuilder:
        """Claims that match the inputs go after the prompt, as ``_evidence_context``."""
        return self._with(claims={"claims": claims, "k": k, "min_score": min_score, "claim_id": claim_id, "text": text_, "source": source}, evidence="_evidence_context")

    def with_grounding(self, sources: list[str] | None = None, threshold: float = 0.3, action: str = "flag") -> PipelineBuilder:
        """Outputs are held against the source columns: ``flag`` adds ``_grounding_score``, ``skip`` also empties outputs."""
        if action not in ("flag", "skip"):
            raise ValueError("action must be flag or skip")
        return self._with(grounding={"sources": sources, "threshold": threshold, "action": action})

    def with_contradiction_detection(self, key: list[str] | None = None, tolerance: float | None = None) -> PipelineBuilder:
        """``_contradiction``: whether an earlier row of the same inputs has other outputs."""
        return self._with(contradictions={"key": key, "tolerance": tolerance})

    def with_confidence_scoring(self, mode: str = "default") -> PipelineBuilder:
        """``_confidence`` from the grounding score."""
        return self._with(confidence=mode)

    # ------------------------------------------------------------ output
    def to_file(self, path: str) -> PipelineBuilder:
        return self._with(out=path)

    def to_csv(self, path: str) -> PipelineBuilder:
        return self._with(out=path)

    def build(self) -> Pipeline:
        s = self.settings
        if s.source is None or not s.outputs or not s.template or s.model is None:
            raise ValueError("a pipeline needs a source, outputs, a template and a model")
        if s.budget and not s.log:
            raise ValueError("a budget is enforced between waves of a response log; give with_log a folder")
        if s.confidence and not s.grounding:
            raise ValueError("confidence is scored from grounding")
        return Pipeline(self.spark, s)


#: Stages by name, for ``with_stage`` and settings files.
STAGES: dict[str, Stage] = {}


def stage(name: str) -> Callable[[Stage], Stage]:
    """Register a DataFrame transform under a name."""

    def add(fn: Stage) -> Stage:
        if name in STAGES:
            raise ValueError(f"stage {name!r} exists already")
        STAGES[name] = fn
        return fn

    return add


@dataclass
class Pipeline:
    spark: SparkSession
    s: Settings
    run: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        self.tell = Dispatcher(self.run, self.s.observers)
        if (self.s.remote or self.s.retries) and not self.s.log:
            # what a model was paid for is never computed twice: replies of clients are always written first
            self.s = replace(self.s, log=store.new_path(self.spark, "responses"), session=self.run)

    def add_observer(self, observer: Any) -> Pipeline:
        return Pipeline(self.spark, replace(self.s, observers=[*self.s.observers, observer]), self.run)

    def _staged(self, df: DataFrame, place: str) -> DataFrame:
        for at, stage_ in self.s.stages:
            if at == place:
                df = stage_(df)
        return df

    def rows(self) -> DataFrame:
        """The input with its row index."""
        s = self.s
        df = self._staged(readers.read(self.spark, s.source, **s.reading), "after_load")
        df = rows.where_equal(rows.require(df, s.inputs), s.filters)
        if s.key:
            return rows.with_row_index(df, s.key)
        return rows.with_row_index(store.written(df.withColumn("__at", F.monotonically_increasing_id())), "__at").drop("__at")

    def _query(self) -> Column:
        return F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in self.s.inputs])

    def prompts(self, df: DataFrame) -> DataFrame:
        """(index, prompt)"""
        s = self.s
        for c in s.inputs if s.clean or s.redact else []:
            if dict(df.dtypes)[c] == "string":
                value = text.clean(F.col(f"`{c}`")) if s.clean else F.col(f"`{c}`")
                df = df.withColumn(c, text.redact(value) if s.redact else value)
        if s.knowledge:
            q, b = df.select(F.col(rows.INDEX).alias("query_id"), self._query().alias("query")), s.knowledge
            hits = retrieval.search(b["chunks"], q, b["k"], b["chunk_id"], b["text"], **b["options"])
            found = retrieval.context(hits, b["chunks"], "query_id", b["chunk_id"], b["text"]).select(F.col("query_id").alias(rows.INDEX), "_kb_context")
            df = df.join(found, rows.INDEX, "left")
        if s.claims:
            q, b = df.select(F.col(rows.INDEX).alias("query_id"), self._query().alias("query")), s.claims
            found = retrieval.evidence(b["claims"], q, b["k"], b["min_score"], b["claim_id"], b["text"], b["source"]).withColumnRenamed("query_id", rows.INDEX)
            df = df.join(found, rows.INDEX, "left")
        df = self._staged(df, "before_prompt")
        shown = prompt.render(df, s.template, s.examples, s.context if s.context in df.columns else None, s.evidence if s.evidence in df.columns else None)
        return df.select(rows.INDEX, (F.concat(F.lit(f"{s.system}\n\n"), shown) if s.system and not s.remote else shown).alias("prompt"))

    def validate(self) -> None:
        """Analysis finds missing columns; the parser and the policy are built, so they raise here too."""
        self.prompts(self.rows()).schema  # noqa: B018
        parsing.outputs(F.lit(""), self.s.outputs, self.s.parser, self.s.patterns, self.s.schema)
        if self.s.policy not in ("skip", "use_default", "fail"):
            raise ValueError(f"unknown policy {self.s.policy!r}")

    def estimate(self) -> DataFrame:
        return cost.estimate(self.prompts(self.rows()), F.col("prompt"), rows.INDEX, *self.s.prices)

    def _make(self, deployment: str | None) -> Callable[[], invoke.Client]:
        make, given = self.s.model, {k: v for k, v in (("system", self.s.system), ("deployment", deployment)) if v is not None}
        return (lambda: make(**given)) if given else make

    def _invoke(self, calls: DataFrame, keep: list[str]) -> DataFrame:
        s = self.s
        options = {**s.client, "schema": s.schema if s.parser == "schema" and s.pack == 1 else None}
        if not s.router:
            return invoke.invoke(calls, "prompt", self._make(None), keep, **options)
        strategy, deployments = s.router
        routed = runs.assign(calls, keep[0] if s.pack == 1 else "first", strategy, deployments)
        parts = [invoke.invoke(routed.where(F.col("deployment") == d), "prompt", self._make(d), keep, **options) for d in deployments]
        done = parts[0]
        for p in parts[1:]:
            done = done.union(p)
        return done

    def _call(self, prompts: DataFrame) -> DataFrame:
        """(index, reply, tokens_in, tokens_out, error) of each row."""
        s = self.s
        if s.pack == 1:
            calls, key = prompts, [rows.INDEX]
        else:
            calls = batches.pack(prompts.withColumn("__p", F.col(rows.INDEX)), s.pack, rows.INDEX, batches.BLOCK, "prompt")
            calls, key = calls.withColumn("prompt", batches.mega_prompt(F.col("items"), "prompt")), ["block", "slot", "first", "n", "items"]
        if s.remote:
            done = self._invoke(calls, key)
        else:
            done = calls.select(*key, s.model(F.col("prompt")).alias("reply"), text.token_estimate(F.col("prompt")).alias("tokens_in"), F.lit(None).cast("string").alias("error"))
            done = done.withColumn("tokens_out", text.token_estimate(F.col("reply")))
        if s.pack == 1:
            return done.select(rows.INDEX, "reply", "tokens_in", "tokens_out", "error")
        return batches.unpack(done, "reply", rows.INDEX, shared=("tokens_in", "tokens_out"), also="error").select(rows.INDEX, F.col("result").alias("reply"), "tokens_in", "tokens_out", F.col("failure").alias("error"))

    def _ask(self, log: resume.ResponseLog, prompts: DataFrame) -> None:
        """Call for these rows and write the replies down before anything reads them."""
        s = self.s
        priced = self._call(prompts).withColumn("cost", cost.call_cost(F.col("tokens_in"), F.col("tokens_out"), *s.prices))
        log.append(priced.select(F.lit(s.session).alias("session"), F.col(rows.INDEX).alias("row_index"), F.unix_micros(F.current_timestamp()).alias("version"), "reply", "tokens_in", "tokens_out", "error", "cost"))

    def _read(self, log: resume.ResponseLog) -> DataFrame:
        return log.read(self.s.session, _LOG)

    def spent(self) -> Decimal:
        """What all calls of the session cost, those that were asked again included."""
        return resume.ResponseLog(self.spark, self.s.log).spent(self.s.session) if self.s.log else Decimal(0)

    def replies(self, df: DataFrame) -> DataFrame:
        """Replies of all rows; with a log, what it has is not asked again and each wave is durable before the next.

        A wave in which a call failed for good (a key that is refused) is the last: the run stops with an error, and
        what was answered stays in the log.
        """
        s = self.s
        prompts = self.prompts(df)
        if not s.log:
            return self._call(prompts)
        log = resume.ResponseLog(self.spark, s.log)
        began = int(time.time() * 1e6)
        left = resume.pending(prompts, self._read(log).where("error is null").withColumnRenamed("row_index", rows.INDEX), rows.INDEX)
        for wave in range(s.waves):
            if s.budget and self.spent() > Decimal(s.budget):
                self.tell("budget", detail=f"more than {s.budget} is spent")
                break
            block = F.col(rows.INDEX) if s.pack == 1 else F.floor(F.col(rows.INDEX) / batches.BLOCK)
            self._ask(log, left.where(F.pmod(F.xxhash64(block), F.lit(s.waves)) == wave) if s.waves > 1 else left)
            self.tell("wave", stage=str(wave))
            self._stop_on_fatal(log, began)
        for n in range(1, s.retries + 1):
            lost = quality.failed_rows(self.parse(self._got(log)), s.outputs).select(rows.INDEX)
            if lost.isEmpty() or (s.budget and self.spent() > Decimal(s.budget)):
                break
            self.tell("retry", stage=str(n))
            self._ask(log, prompts.join(lost, rows.INDEX, "left_semi"))
        return self._got(log)

    def _got(self, log: resume.ResponseLog) -> DataFrame:
        return self._read(log).select(F.col("row_index").alias(rows.INDEX), "reply", "tokens_in", "tokens_out", "error")

    def _stop_on_fatal(self, log: resume.ResponseLog, began: int) -> None:
        """Errors of earlier runs are no reason to stop: their rows are asked again."""
        bad = self._read(log).where(F.col("version") >= began).where(parsing.error_kind(F.col("error")).isin(*self.s.client.get("stop_on", ("auth",))))
        if self.s.remote and (row := bad.select("error").first()):
            self.tell("error", detail=row["error"])
            raise RuntimeError(f"the run stopped: {row['error']}")

    def parse(self, got: DataFrame) -> DataFrame:
        """(index, outputs): rows with an error become what the policy says."""
        s = self.s
        cells = parsing.outputs(F.col("reply"), s.outputs, s.parser, s.patterns, s.schema)
        parsed = got.select(rows.INDEX, "error", *[c.alias(n) for n, c in cells.items()])
        return quality.apply_policy(parsed, s.outputs, "error", s.policy, s.default).drop("error")

    def errors(self) -> DataFrame:
        """(row_index, error, error_kind) of the rows that have no reply; needs a log."""
        log = resume.ResponseLog(self.spark, self.s.log)
        return self._read(log).where("error is not null").select("row_index", "error", parsing.error_kind(F.col("error")).alias("error_kind"))

    def _verified(self, df: DataFrame) -> DataFrame:
        """Grounding, contradiction and confidence columns."""
        s = self.s
        if s.grounding:
            g = s.grounding
            df = grounding.verify(df, rows.INDEX, s.outputs, g["sources"] or s.inputs, g["threshold"], g["action"])
            if s.confidence:
                df = df.withColumn("_confidence", grounding.confidence(F.col("_grounding_score"), mode=s.confidence))
        if s.contradictions:
            c = s.contradictions
            key = F.concat_ws("\x1f", *[F.col(f"`{x}`").cast("string") for x in c["key"] or s.inputs])
            said = F.concat_ws(" ", *[F.col(f"`{x}`") for x in s.outputs])
            df = grounding.flag_contradictions(df.withColumns({"__key": key, "__said": said}), "__key", "__said", rows.INDEX, c["tolerance"]).drop("__key", "__said")
        return df

    def execute(self) -> DataFrame:
        """The input with the output columns; written to the file, if one is set."""
        s = self.s
        self.tell("start")
        try:
            df = self.rows()
            got = self._staged(self.replies(df), "after_reply")
            parsed = self.parse(got)
            if s.log and s.guard:
                sums = got.agg(F.count("error"), F.coalesce(F.sum(F.col("tokens_in") + F.col("tokens_out")), F.lit(0))).first()
                quality.guard(parsed, s.outputs, sums[0], sums[1])
            merged = merge.merge_results(df, parsed, rows.INDEX, s.merge)
            merged = self._staged(self._verified(merged).drop(rows.INDEX), "after_merge")
            done = writers.write(merged, s.out) if s.out else merged
        except Exception as e:
            self.tell("error", detail=str(e)[:500])
            raise
        self.tell("end", cost=self.spent() if s.log else None)
        return done

    def execute_async(self) -> Future:
        """``execute`` in a thread of its own; Spark runs the jobs of several at once."""
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(self.execute)
        finally:
            pool.shutdown(wait=False)

    def sample(self, n: int) -> DataFrame:
        """The first n rows only."""
        first = rows.head(self.rows(), n, rows.INDEX).drop(rows.INDEX)
        return Pipeline(self.spark, replace(self.s, source=first, reading={}, filters={}, log=None, budget=None, out=None)).execute()

    # ------------------------------------------------------------ streams
    def execute_stream(self, out: str, checkpoint: str, files_per_batch: int = 16, on_error: str = "fail") -> StreamingQuery:
        """New files of the source folder, batch by batch, each through the pipeline and into ``out/batch=N``.

        A batch is a run of its own; one that runs again replaces itself.  ``on_error`` ``skip`` leaves a batch that
        fails out and goes on; its error is an event.
        """
        s = self.s
        if on_error not in ("fail", "skip"):
            raise ValueError("on_error must be fail or skip")
        stream = runner.stream_files(self.spark, s.source, readers.read(self.spark, s.source, **s.reading).schema, readers.format_of(s.source), files_per_batch)

        def each(batch: DataFrame, number: int) -> DataFrame | None:
            try:
                one = replace(s, source=batch, reading={}, out=None, log=s.log and f"{s.log}/batch={number}")
                return Pipeline(self.spark, one, f"{self.run}-{number}").execute()
            except Exception as e:
                if on_error == "fail":
                    raise
                self.tell("error", stage=f"batch {number}", detail=str(e)[:500])
                return None

        return runner.run_batches(stream, each, out, checkpoint)

    def stream_results(self, size: int = 10_000) -> Iterator[DataFrame]:
        """The result in pieces of ``size`` rows of the input, each computed when it is asked for."""
        df = self.rows()
        many = df.agg(F.max(rows.INDEX)).first()[0]
        for a in range(0, (many if many is not None else -1) + 1, size):
            part = df.where(F.col(rows.INDEX).between(a, a + size - 1)).drop(rows.INDEX)
            yield Pipeline(self.spark, replace(self.s, source=part, reading={}, filters={}, out=None, log=self.s.log and f"{self.s.log}/from={a}"), f"{self.run}-{a}").execute()

    # ------------------------------------------------------------ provider batches
    def submit(self, to: provider.BatchProvider, folder: str) -> provider.Batch:
        """Write all prompts as a provider's requests and hand them in; ``collect`` of the batch's pipeline reads them back.

        The rows are written beside the requests, so that they are numbered alike when the replies come.
        """
        s = self.s
        if s.pack != 1:
            raise ValueError("a provider's batch takes one row a request")
        df = self.rows()
        df.write.mode("overwrite").parquet(f"{folder}/rows")
        df = self.spark.read.parquet(f"{folder}/rows")
        system = F.lit(s.system) if s.system else None
        jsonl.encode(self.prompts(df), rows.INDEX, "prompt", to.model, system).select("line").write.mode("overwrite").text(f"{folder}/requests")
        registry = runs.Registry(self.spark, f"{folder}/state")
        registry.move(self.run, "submitted")
        batch = provider.Batch(self.run, to.submit(f"{folder}/requests", f"{folder}/replies"), folder)
        registry.move(self.run, "running")
        return batch

    def collect(self, batch: provider.Batch, frm: provider.BatchProvider) -> DataFrame:
        """The result of a batch that the provider has done; an error if it has not."""
        registry = runs.Registry(self.spark, f"{batch.folder}/state")
        state = frm.poll(batch.id)
        if state != "completed":
            if state == "failed":
                registry.move(batch.run, "failed")
            raise RuntimeError(f"the batch is {state}")
        df = self.spark.read.parquet(f"{batch.folder}/rows")
        got = jsonl.decode(self.spark.read.text(f"{batch.folder}/replies").withColumnRenamed("value", "line"))
        got = got.select(F.col("row_index").alias(rows.INDEX), "reply", F.coalesce("error", F.when(F.col("reply").isNull(), "no reply")).alias("error"))
        registry.move(batch.run, "completed")
        return self._staged(merge.merge_results(df, self.parse(got), rows.INDEX, self.s.merge).drop(rows.INDEX), "after_merge")


def enrich(df: Any, template: str, outputs: list[str], model: invoke.ColumnModel | None = None, key: str | None = None, client: Callable[[], invoke.Client] | None = None, spark: SparkSession | None = None, **settings: Any) -> Any:
    """New columns by one prompt a row: the inputs are the template's placeholders.

    ``model`` is an expression over the prompt, ``client`` makes a remote model.  What is no Spark frame (pandas,
    polars, rows) comes back as pandas.
    """
    if (model is None) == (client is None):
        raise ValueError("give either a model or a client")
    session = df.sparkSession if isinstance(df, DataFrame) else spark or SparkSession.active()
    builder = PipelineBuilder(session).from_source(df, prompt.placeholders(template), outputs, key).with_prompt(template)
    builder = builder.with_column_model(model) if model is not None else builder.with_client(client)
    done = Pipeline(session, replace(builder.build().s, **settings)).execute()
    return done if isinstance(df, DataFrame) else done.toPandas()


def from_config(spark: SparkSession, source: str | dict[str, Any], model: invoke.ColumnModel | None = None, client: Callable[[], invoke.Client] | None = None) -> Pipeline:
    """A pipeline from a settings file or its content; the model is code, so it is given."""
    from rowloom.sources.config import load

    c = load(source) if isinstance(source, str) else source
    d, p, o, r = c.get("dataset", {}), c.get("prompt", {}), c.get("output", {}), c.get("processing", {})
    b = PipelineBuilder(spark).from_source(d.get("path") or d.get("source_path"), d["input_columns"], d["output_columns"], d.get("key"), **d.get("reading", {}))
    b = b.with_prompt(p["template"], [tuple(x) for x in p.get("examples", [])]).with_batch_size(p.get("batch_size", 1)).with_parser(c.get("parser", "raw"), c.get("patterns"), c.get("schema"))
    if p.get("system"):
        b = b.with_system_prompt(p["system"])
    if r.get("rate_limit"):
        b = b.with_rate_limit(float(r["rate_limit"]))
    if r.get("concurrency"):
        b = b.with_concurrency(int(r["concurrency"]))
    if r.get("log"):
        b = b.with_log(r["log"], r.get("session", "default"), int(r.get("waves", 1)))
    if r.get("budget"):
        b = b.with_budget(str(r["budget"]))
    if r.get("error_policy"):
        b = b.with_error_policy(r["error_policy"], r.get("default"))
    if o.get("path"):
        b = b.to_file(o["path"])
    if o.get("merge"):
        b = b.with_merge(o["merge"])
    return (b.with_client(client) if client is not None else b.with_column_model(model)).build()
