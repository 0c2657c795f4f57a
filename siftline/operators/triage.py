"""Triage: the ladder that decides which findings a model is asked about, its replies checked, and their analyses.

A finding is held for lack of source, held for directives in its source, answered from the cache, held by the token
budget, or asked; a reply is checked, asked for again if it is unusable, and held if it cites lines that weren't shown.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import fixed, guards
from siftline.functions import scalar as S
from siftline.operators import scans
from siftline.operators.graph import written
from siftline.sources.model import ModelError, ModelReply

REPLY = "verdict string, reachability string, confidence double, rationale string, citations array<struct<line_start:int,line_end:int,note:string>>, impact string, remediation string"
KEYS = ("verdict", "reachability", "confidence", "rationale", "citations", "impact", "remediation")
INPUT_TOKENS, OUTPUT_TOKENS, CHARS_PER_TOKEN = 2_000_000, 400_000, 4
#: Requests that a task has under way.
WINDOW = 8
ANALYSIS = ("verdict", "confidence", "rationale", "evidence", "impact", "remediation", "holds")
EVIDENCE = "array<struct<file_path:string,line_start:int,line_end:int,note:string>>"
PLACE = ("file_path", "line_start", "line_end")


def parse_reply(raw: Column) -> Column:
    """struct(reply, problem): the JSON object in a model's answer, and what is wrong with it (null if nothing)."""
    block = F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))
    x = F.from_json(block, REPLY)
    keys = F.json_object_keys(block)
    extra = F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, KEYS)))
    cites = F.coalesce(x["citations"], F.array().cast("array<struct<line_start:int,line_end:int,note:string>>"))
    bad_cite = F.exists(cites, lambda c: F.coalesce((c["line_start"] < 1) | (c["line_end"] < c["line_start"]) | ~F.length(c["note"]).between(1, 300), F.lit(True)))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    problem = (
        F.when(block.isNull(), "no JSON object").when(x.isNull() | keys.isNull() | F.try_parse_json(block).isNull(), "malformed JSON").when(F.size(extra) > 0, "unknown keys")
        .when(no(x["verdict"].isin(*fixed.VERDICTS)), "verdict").when(no(x["reachability"].isin(*fixed.REACHABILITY)), "reachability").when(no(x["confidence"].between(0, 1)), "confidence")
        .when(no((F.length(x["rationale"]) <= 2000) & (S.strip(x["rationale"]) != "")), "rationale").when((F.size(cites) > 20) | bad_cite, "citations")
        .when((x["verdict"] != "needs_human") & (F.size(cites) == 0), "decisive without citation").when((x["verdict"] == "false_positive") & (x["reachability"] == "untrusted_input"), "dismissed though reachable")
        .when((x["reachability"] == "unknown") & (x["confidence"] > 0.85), "too sure")
    )
    return F.struct(x.alias("reply"), problem.alias("problem"))


def usable(raw: str) -> bool:
    """Whether ``parse_reply`` finds no problem: the same rules for the one task that asks, where another attempt depends on it."""
    found = re.search(r"\{.*\}", raw, re.S)
    try:
        x = json.loads(found[0]) if found else None
    except ValueError:
        return False
    if not isinstance(x, dict) or set(x) - set(KEYS):
        return False
    cites, text, sure = x.get("citations") or [], x.get("rationale"), x.get("confidence")
    number = lambda v: isinstance(v, int) and not isinstance(v, bool)
    cited = lambda c: isinstance(c, dict) and number(c.get("line_start")) and number(c.get("line_end")) and 1 <= c["line_start"] <= c["line_end"] and isinstance(c.get("note"), str) and 1 <= len(c["note"]) <= 300
    sound = x.get("verdict") in fixed.VERDICTS and x.get("reachability") in fixed.REACHABILITY and isinstance(sure, int | float) and not isinstance(sure, bool) and 0 <= sure <= 1
    sound = sound and isinstance(text, str) and len(text) <= 2000 and text.strip() != "" and isinstance(cites, list) and len(cites) <= 20 and all(map(cited, cites))
    return sound and not ((x["verdict"] != "needs_human" and not cites) or (x["verdict"] == "false_positive" and x["reachability"] == "untrusted_input") or (x["reachability"] == "unknown" and sure > 0.85))


def gate(findings: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Adds ``route``: held for lack of source, held for directives, cached, or ask.  Needs matched, suspicious, cache_key."""
    x = findings if cache is None else findings.join(cache.select("cache_key", F.lit(True).alias("hit")).distinct(), "cache_key", "left")
    hit = F.coalesce("hit", F.lit(False)) if cache is not None else F.lit(False)
    return x.withColumn("route", F.when(F.coalesce("matched", F.lit("")) == "", "hold:evidence").when(F.col("suspicious"), "hold:injection").when(hit, "cached").otherwise("ask"))


def ask(asked: DataFrame, client: Callable[[str], tuple | ModelReply], attempts: int = 2, budget: tuple[int, int] | None = (INPUT_TOKENS, OUTPUT_TOKENS), accept: Callable[[str], bool] = usable,
        window: int = WINDOW, reserve: Callable[[str], tuple[int, int]] | None = None) -> DataFrame:
    """(ord, raw, status, detail, used_in, used_out): sends each prompt (ord, prompt, optional key) in order while the budget lasts.

    The budget is one running state, so rows go through one task in their order, but only while it can still pay: the
    prompts' estimated tokens are summed over ranges of the order, and one stretch of at most the input budget at a time
    is sent; when no prompt of the rest can be paid any more, the rest is held without leaving the JVM.  A row that the
    budget stops costs nothing; of rows of one ``key`` the first one that is answered stands for those after it (status
    ``cached``).  Without a budget the rows are asked where they lie, and share keys within a task only.  ``client``
    returns (text, tokens in, tokens out) and raises ModelError or ConnectionError; an unusable text is asked for again.

    A task has up to ``window`` requests under way and takes the replies in the rows' order, so the rows are those of a
    serial run whatever the latencies; ``client`` is called from threads.  A request is sent ahead only where what is under
    way leaves it its tokens: ``reserve`` says what a prompt may cost at most (tokens in and out of all its attempts).
    Without it a task's first request goes alone, and then as much is set aside for each as the dearest one so far took.  A
    reply that costs more than was set aside can only mean that a request sent ahead turns out to be held, its reply unused.
    Runs its jobs when it is called, but for the last.
    """
    key = F.col("key") if "key" in asked.columns else F.lit(None).cast("string")
    rows = asked.select("ord", key.alias("key"), "prompt")
    kind = rows.schema["ord"].dataType.simpleString()
    schema = f"ord {kind}, key string, raw string, status string, detail string, used_in long, used_out long"

    def asking(used: list[int]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            spent, dearest, answered = list(used), [], set()
            with ThreadPoolExecutor(window) as pool:
                for batch in batches:
                    rows = list(zip(batch["ord"], batch["key"], batch["prompt"], batch["known"]))
                    out = in_window(rows, pool, spent, dearest, answered) if budget else freely(rows, pool, spent, answered)
                    yield pd.DataFrame(out, columns=["ord", "key", "raw", "status", "detail", "used_in", "used_out"])

        return run

    def one(prompt: str) -> tuple[str | None, bool, int, int]:
        """A prompt's last text, whether it is accepted, and the tokens of all its attempts."""
        raw, a, b = None, 0, 0
        for _ in range(attempts):
            try:
                reply = client(prompt)
            except (ModelError, ConnectionError):
                return None, False, a, b
            raw, more_in, more_out = (reply.text, reply.input_tokens, reply.output_tokens) if isinstance(reply, ModelReply) else reply
            a, b = a + more_in, b + more_out
            if accept(raw):
                return raw, True, a, b
        return raw, False, a, b

    def in_window(rows: list[tuple], pool: ThreadPoolExecutor, spent: list[int], dearest: list[int], answered: set) -> list[tuple]:
        """The rows in order; prompts behind the one that is due are sent ahead where they are sure to be asked."""
        sent: dict[int, Future] = {}
        ahead, out = 0, []

        def sure(no: int) -> bool:
            """Whether row ``no`` will be asked whatever the replies under way cost, as long as they keep within ``reserve``."""
            name, prompt = rows[no][1:3]
            if name is not None and any(rows[k][1] == name for k in sent):
                return False
            if budget:
                if not (reserve or dearest):
                    return not sent
                tokens = lambda text: len(text) // CHARS_PER_TOKEN
                held = [reserve(rows[k][2]) if reserve else (attempts * max(tokens(rows[k][2]), dearest[0]), attempts * max(1, dearest[1])) for k in sent]
                return spent[0] + sum(a for a, _ in held) + len(prompt) // CHARS_PER_TOKEN <= budget[0] and spent[1] + sum(b for _, b in held) < budget[1]
            return True

        for due, (no, name, prompt, known) in enumerate(rows):
            ahead = max(ahead, due)
            while ahead < len(rows) and len(sent) < window:
                if not (rows[ahead][3] or rows[ahead][1] is not None and rows[ahead][1] in answered):
                    if sure(ahead):
                        sent[ahead] = pool.submit(one, rows[ahead][2])
                    elif budget and not (rows[ahead][1] is not None and any(rows[k][1] == rows[ahead][1] for k in sent)):
                        break  # the budget may end before it
                ahead += 1
            under_way = sent.pop(due, None)
            if known or (name is not None and name in answered):
                out.append((no, name, None, "cached", None, *spent))
                continue
            if budget and spent[0] + len(prompt) // CHARS_PER_TOKEN > budget[0]:
                out.append((no, name, None, "hold:budget", f"input budget exhausted: {spent[0]}/{budget[0]}", *spent))
                continue
            if budget and spent[1] >= budget[1]:
                out.append((no, name, None, "hold:budget", "output budget exhausted", *spent))
                continue
            raw, good, a, b = under_way.result() if under_way else one(prompt)
            spent[:] = spent[0] + a, spent[1] + b
            dearest[:] = [max(x) for x in zip(dearest or (0, 0), (a, b))]
            if good and name is not None:
                answered.add(name)
            out.append((no, name, raw, "answered" if good else "hold:evidence", None if good else fixed.NO_RESPONSE, *spent))
        return out

    def freely(rows: list[tuple], pool: ThreadPoolExecutor, spent: list[int], answered: set) -> list[tuple]:
        """The rows in order, without a budget: each thread takes the next row, or the next key's rows, until none is left, so no
        request waits for an earlier one's reply, and threads are started once a batch."""
        todo: dict[tuple, list[int]] = {}
        for no, (_, name, _, known) in enumerate(rows):
            if not known and (name is None or name not in answered):
                todo.setdefault(("row", no) if name is None else ("key", name), []).append(no)
        left, replies = deque(todo.values()), {}

        def take() -> None:
            try:
                while True:
                    try:
                        own = left.popleft()
                    except IndexError:
                        return
                    for no in own:
                        replies[no] = one(rows[no][2])
                        if replies[no][1]:
                            break
            except BaseException:
                left.clear()
                raise

        for thread in [pool.submit(take) for _ in range(window)]:
            thread.result()
        out = []
        for no, (ord_, name, _, _) in enumerate(rows):
            if no not in replies:
                out.append((ord_, name, None, "cached", None, *spent))
                continue
            raw, good, a, b = replies.pop(no)
            spent[:] = spent[0] + a, spent[1] + b
            if good and name is not None:
                answered.add(name)
            out.append((ord_, name, raw, "answered" if good else "hold:evidence", None if good else fixed.NO_RESPONSE, *spent))
        return out

    def flagged(df: DataFrame) -> DataFrame:
        """With ``known``: whether an earlier stretch has answered the row's key."""
        found = [x.where("status = 'answered' AND key IS NOT NULL").select(F.col("key").alias("of"), F.lit(True).alias("known")) for x in done]
        if not found:
            return df.withColumn("known", F.lit(False))
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        return df.join(every.distinct(), F.col("key") == F.col("of"), "left").drop("of").withColumn("known", F.coalesce("known", F.lit(False)))

    done: list[DataFrame] = []
    if budget is None:
        return flagged(rows).mapInPandas(asking([0, 0]), schema)
    slices = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = rows.withColumn("tokens", F.floor(F.length("prompt") / CHARS_PER_TOKEN))
    x = written(x.repartitionByRange(slices, "ord").withColumn("slice", F.spark_partition_id()), "prompts")
    sums = x.groupBy("slice").agg(F.sum("tokens").alias("n")).select(F.col("slice").alias("of"), F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("slice").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = written(x.withColumn("at", inside).join(sums, F.col("slice") == F.col("of")).withColumn("at", F.col("at") + F.col("before")).drop("of", "before", "slice"), "prompts")
    most, used, lo = max(1, budget[0]), [0, 0], 0
    while True:
        rest = x.where(F.col("at") >= lo).agg(F.min("tokens").alias("least"), F.min("at").alias("first")).first()
        if rest.first is None:
            break
        if used[1] >= budget[1] or used[0] + rest.least > budget[0]:
            detail = F.when(F.col("tokens") + used[0] > budget[0], f"input budget exhausted: {used[0]}/{budget[0]}").otherwise("output budget exhausted")
            status = F.when(F.col("known"), "cached").otherwise("hold:budget")
            done.append(flagged(x.where(F.col("at") >= lo)).select("ord", "key", F.lit(None).cast("string").alias("raw"), status.alias("status"), F.when(~F.col("known"), detail).alias("detail"), F.lit(used[0]).cast("long").alias("used_in"), F.lit(used[1]).cast("long").alias("used_out")))
            break
        lo, hi = rest.first, rest.first + most
        part = flagged(x.where((F.col("at") >= lo) & (F.col("at") < hi))).select("ord", "key", "prompt", "known").repartition(1).sortWithinPartitions("ord").mapInPandas(asking(used), schema)
        part = written(part, "asked")
        last = part.agg(F.max("used_in").alias("a"), F.max("used_out").alias("b")).first()
        used, lo = [last.a, last.b], hi
        done.append(part)
    out = done[0] if done else asked.sparkSession.createDataFrame([], schema)
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _quoted(text: Column) -> Column:
    """A text in quotes, with backslashes, tabs and (if both kinds of quotes occur) single quotes escaped."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t"))
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def to_analysis(reply: Column, file_path: Column) -> dict[str, Column]:
    """The columns of an analysis from a checked reply: citations become evidence in the finding's own file."""
    cites = F.coalesce(reply["citations"], F.array().cast("array<struct<line_start:int,line_end:int,note:string>>"))
    evidence = F.transform(cites, lambda c: F.struct(file_path.alias("file_path"), c["line_start"].alias("line_start"), c["line_end"].alias("line_end"), c["note"].alias("note")))
    return {k: reply[k] for k in ("verdict", "confidence", "rationale", "impact", "remediation")} | {"evidence": evidence, "holds": F.array().cast("array<string>")}


def enforce_window(analyses: DataFrame) -> DataFrame:
    """Holds analyses whose evidence lies outside ``context`` (from ``context_start`` on): verdict needs_human, hold evidence."""
    inside = F.coalesce(F.size("evidence") == 0, F.lit(True)) | guards.within_window(F.col("evidence"), F.col("context"), F.col("context_start"))
    held = F.array_union("holds", F.array(F.lit("evidence")))
    return analyses.withColumns({"verdict": F.when(inside, F.col("verdict")).otherwise("needs_human"), "holds": F.when(inside, F.col("holds")).otherwise(held)})


def triage(
    findings: DataFrame, snippets: DataFrame, client: Callable[[str], tuple | ModelReply], template: str, model_id: str, prompt_version: str,
    cache: DataFrame | None = None, budget: tuple[int, int] | None = None, attempts: int = 2, unicode: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(analyses, fresh): an analysis a finding, and the rows to add to the cache.

    ``findings``: ord, instance_id, rule_id, title, description, cwe_ids, file_path, line_start, line_end; ``snippets``:
    the place, matched, context, context_start; ``cache``: cache_key and the columns of ANALYSIS (None: nothing is
    cached, not even among these findings).  Analyses have ord, instance_id, the columns of ANALYSIS, model_id,
    prompt_version, prompt_hash, cache_key.  Held ones are needs_human with confidence 0.  Fresh rows are the answered
    ones, those held by the evidence window included.  Equal findings get equal analyses where there is a cache; a null
    instance_id is never cached.  Runs its jobs when it is called, but for the last.
    """
    hashed = scans.prompt_hash(template)
    x = findings.join(snippets.select(*PLACE, "matched", "context", "context_start").dropDuplicates(list(PLACE)), list(PLACE), "left")
    x = x.withColumns({"matched": F.coalesce("matched", F.lit("")), "context": F.coalesce("context", F.lit("")), "context_start": F.coalesce("context_start", F.lit(1))})
    shown = F.coalesce(F.nullif("context", F.lit("")), "matched")
    key = F.when(F.col("instance_id").isNotNull(), S.cache_key(F.col("instance_id"), F.lit(hashed), F.lit(model_id))) if cache is not None else F.lit(None).cast("string")
    x = x.withColumns({"signal": guards.first_signal(shown, F.col("context_start"), unicode), "cache_key": key})
    x = gate(x.withColumn("suspicious", F.col("signal").isNotNull()), cache).drop("hit")
    message = F.coalesce(F.nullif("description", F.lit("")), "title")
    cwes = F.coalesce(F.nullif(F.array_join("cwe_ids", ", "), F.lit("")), F.lit("none reported"))
    values = {"rule_id": F.col("rule_id"), "message": message, "cwe": cwes, "file_path": F.col("file_path"), "line_start": F.col("line_start"), "line_end": F.col("line_end"), "context_start": F.col("context_start"), "code": shown}
    x = written(x.withColumn("prompt", F.when(F.col("route") == "ask", scans.render(template, values))), "gated")

    replies = ask(x.where("route = 'ask'").select("ord", F.col("cache_key").alias("key"), "prompt"), client, attempts, budget)
    replies = written(replies.withColumn("parsed", parse_reply(F.col("raw"))), "replies")
    told = x.where("route = 'ask'").join(replies.drop("key"), "ord")
    good = F.col("parsed.problem").isNull() & (F.col("status") == "answered")
    answered = told.where(good)
    answered = enforce_window(answered.withColumns(to_analysis(F.col("parsed.reply"), F.col("file_path"))))
    text, strings = F.lit(None).cast("string"), F.array().cast(EVIDENCE)
    held = lambda df, hold, why: df.withColumns({"verdict": F.lit("needs_human"), "confidence": F.lit(0.0), "rationale": why, "impact": text, "remediation": text, "evidence": strings, "holds": F.array(hold)})
    signal = F.concat(F.lit("line "), F.col("signal.line").cast("string"), F.lit(": "), F.col("signal.reason"), F.lit(" — "), _quoted(F.col("signal.excerpt")))
    parts = [
        answered, held(x.where("route = 'hold:evidence'"), F.lit("evidence"), F.lit(fixed.NO_SOURCE)), held(x.where("route = 'hold:injection'"), F.lit("injection"), signal),
        held(told.where(~good & (F.col("status") != "cached")), F.substring_index(F.coalesce(F.nullif("status", F.lit("answered")), F.lit("hold:evidence")), ":", -1), F.coalesce("detail", F.lit(fixed.NO_RESPONSE))),
    ]
    fresh = answered.where("cache_key IS NOT NULL").select("cache_key", *ANALYSIS)
    if cache is not None:
        known = cache.select("cache_key", *ANALYSIS).dropDuplicates(["cache_key"])
        parts.append(x.where("route = 'cached'").join(known, "cache_key"))
        parts.append(told.where("status = 'cached'").join(fresh, "cache_key"))
    columns = ["ord", "instance_id", *ANALYSIS, "cache_key"]
    every = parts[0].select(*columns)
    for more in parts[1:]:
        every = every.unionByName(more.select(*columns))
    return every.withColumns({"model_id": F.lit(model_id), "prompt_version": F.lit(prompt_version), "prompt_hash": F.lit(hashed)}), fresh


def new_id(prefix: str, digits: int) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:digits]}"


def with_ids(analyses: DataFrame) -> DataFrame:
    """Adds analysis_id, a new one a row and a run; compare analyses without it."""
    return analyses.withColumn("analysis_id", F.concat(F.lit("an_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)))
