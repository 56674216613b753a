"""Enrichment: scraped text, prompts, merges by key, deduced values."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from waypost.functions.clean import UNKNOWN
from waypost.functions.normalize import PROVINCES, postprocess
from waypost.functions.predicates import MANY_UNKNOWN, SHORT_TEXT, unchanged
from waypost.operators.batching import first_unprocessed, numbered
from waypost.operators.search import first_json
from waypost.sources.places import ENRICHED
from waypost.sources.scratch import filed

# Text limits of the prompt, what stands for a missing source, and what answers may say.
SITE_CHARS, REVIEW_CHARS = 2500, 1500
NO_SITE, NO_REVIEW = "(niet beschikbaar)", "(niet gevonden)"
_THREE = ("Ja", "Nee", "Onbekend")
DOMAINS = {
    "provincie": tuple(sorted(set(PROVINCES.values()))),
    "honden_toegestaan": _THREE,
    "stroom": _THREE,
    "afvalwater": _THREE,
    "chemisch_toilet": _THREE,
    "water_tanken": _THREE,
    "ondergrond": ("Gras", "Asfalt", "Grind", "Verhard", "Gemengd", "Onbekend"),
    "toegankelijkheid": _THREE,
    "rust": ("Rustig", "Gemiddeld", "Druk", "Onbekend"),
    "sanitair": _THREE,
    "wifi": _THREE,
    "waterfront": _THREE,
    "roken": _THREE,
    "feesten": _THREE,
    "loc_type": ("Camping", "Camperplaats", "Parking", "Jachthaven", "Boerderij"),
    "tarieftype": ("Per nacht", "Gratis", "Onbekend"),
    "ai_gecheckt": ("Ja",),
}
#: Patterns of answers of a shape instead of a list; each also admits "Onbekend".
_AMOUNT = r"€ ?[0-9]+([.,][0-9]{1,2})?"
SHAPES = {
    "prijs": rf"{_AMOUNT}|Gratis",
    "stroom_prijs": rf"{_AMOUNT}/nacht|Inbegrepen|Nee \(geen stroom\)",
    "aantal_plekken": r"[0-9]+",
    "beoordeling": r"[0-9]([.,][0-9]+)?|10([.,]0+)?",
    "telefoonnummer": r"\+31 (6 [0-9]{4} [0-9]{4}|[0-9]{2} [0-9]{3} [0-9]{4}|[0-9]{3} [0-9]{3} [0-9]{3})",
    "max_lengte": r"[0-9]+([.,][0-9]+)? ?m|Geen beperking",
    "max_gewicht": r"[0-9]+([.,][0-9]+)? ?t|Geen beperking",
    "voertuig_types": r"[A-Z][A-Za-z]+(, [A-Z][A-Za-z]+)*",
}
#: Bounds in words of a free text.
SPANS = {"samenvatting_reviews": (20, 40)}
#: Free texts, which only have to say something.
FREE = ("naam", "check_in_out", "beschrijving", "faciliteiten_extra", "huisregels", "drukte_indicator", "remote_work_score")


def title(html: Column) -> Column:
    """S9's stand-in: a page's title."""
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def page_text(html: Column) -> Column:
    """S9's stand-in: a page without scripts, styles and tags."""
    bare = F.regexp_replace(
        F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " "
    )
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def text_length(*sources: Column) -> Column:
    """A6."""
    total = F.lit(0)
    for c in sources:
        total = total + F.coalesce(F.length(c), F.lit(0))
    return total.cast("long")


def clipped(c: Column, limit: int, missing: str) -> Column:
    """O7."""
    return F.coalesce(F.nullif(F.substring(c, 1, limit), F.lit("")), F.lit(missing))


def changed(new: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (url, hash) with whether the page's hash differs from the known one or is unknown."""
    old = known.select("url", F.col("hash").alias("old_"))
    return new.join(old, "url", "left").withColumn(
        "changed", ~F.col("hash").eqNullSafe(F.col("old_")) | F.col("hash").isNull()
    ).drop("old_")


def _unknown(c: Column) -> Column:
    return F.lower(F.trim(c)) == "onbekend"


def fill_unknown(base: DataFrame, updates: DataFrame, columns: list[str], key: str = "place_id") -> DataFrame:
    """Updates replace unknown values only, and only by known ones."""
    named = updates.select(key, *[F.col(c).alias(f"{c}_new") for c in columns])
    joined = base.join(named, key, "left")
    value = lambda c: F.when(
        _unknown(F.col(c)) & ~F.coalesce(_unknown(F.col(f"{c}_new")), F.lit(True)), F.col(f"{c}_new")
    ).otherwise(F.col(c))
    return joined.withColumns({c: value(c) for c in columns}).drop(*[f"{c}_new" for c in columns])


def upsert(base: DataFrame, updates: DataFrame, key: str = "place_id") -> DataFrame:
    """Changed cells by key; new columns come in as unknown; only rows with a result count as processed."""
    changed_columns = [c for c in updates.columns if c != key and not c.startswith("_")]
    named = updates.select(key, *[F.col(c).alias(f"{c}_new") for c in changed_columns], F.lit(True).alias("hit_"))
    joined = base.join(named, key, "left")
    out = {c: F.coalesce(F.col(f"{c}_new"), F.col(c) if c in base.columns else F.lit(UNKNOWN)) for c in changed_columns}
    out["ai_gecheckt"] = F.when(F.col("hit_"), "Ja").otherwise(F.col("ai_gecheckt"))
    return joined.withColumns(out).drop("hit_", *[f"{c}_new" for c in changed_columns])


def paired(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """A batch's listed outputs (batch, items) meet its inputs (batch, pos); what is over is dropped."""
    listed = outputs.select("batch", F.posexplode("items").alias("pos", "item"))
    return inputs.join(listed, ["batch", "pos"])


def prompts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per batch one prompt: a block of sources for each of its rows in place order, then the rows' data.

    Rows have batch, place_id, the columns, and may have naam and provincie for
    the block's head, site_text, the texts of two review sites (camper_text,
    park_text) and total_len; a missing text is told as such, a missing length
    is that of the three texts.
    """
    text = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    site, camper, park = text("site_text"), text("camper_text"), text("park_text")
    total = F.col("total_len") if "total_len" in df.columns else text_length(site, camper, park)
    head = F.concat(F.coalesce(text("naam"), F.lit("?")), F.lit(" ("), F.coalesce(text("provincie"), F.lit("?")), F.lit(")"))
    sources = F.concat(
        F.lit("Website ("), total.cast("string"), F.lit(" tekens): "), clipped(site, SITE_CHARS, NO_SITE), F.lit("\nReviews 1: "),
        clipped(camper, REVIEW_CHARS, NO_REVIEW), F.lit("\nReviews 2: "), clipped(park, REVIEW_CHARS, NO_REVIEW), F.lit("\n")
    )
    gathered = df.groupBy("batch").agg(
        F.sort_array(F.collect_list(F.struct("place_id", head.alias("head"), sources.alias("sources"), F.to_json(F.struct(*columns)).alias("data")))).alias("rows")
    )
    block = lambda x, i: F.concat(F.lit("--- Plek "), (i + 1).cast("string"), F.lit(": "), x["head"], F.lit(" ---\n"), x["sources"])
    told = F.array_join(F.transform("rows", block), "\n")
    data = F.array_join(F.transform("rows", lambda x: F.concat(F.lit("Data: "), x["data"])), "\n")
    return gathered.select("batch", F.concat(told, F.lit("\n"), data).alias("prompt"))


def deduced(df: DataFrame) -> DataFrame:
    """Facts that the name, description or reviews imply where nothing is known."""
    text = lambda *names: F.lower(F.concat_ws(" ", *[F.col(c) for c in names if c in df.columns]))
    name, told, reviews = text("naam"), text("naam", "beschrijving"), text("samenvatting_reviews")
    parking, harbour, camping = name.rlike("parking|parkeer"), name.rlike("jachthaven|marina"), name.rlike(
        "camping|vakantiepark"
    )
    facts = {
        "stroom": F.when(told.rlike("stroomaansluiting|stroompunt|stroompaal|stroom aanwezig|[0-9]+ ?amp"), "Ja").when(parking, "Nee"),
        "sanitair": F.when(parking, "Nee").when(harbour | camping | reviews.contains("muntjes douche"), "Ja"),
        "water_tanken": F.when(harbour | camping, "Ja"),
        "afvalwater": F.when(harbour, "Ja"),
        "check_in_out": F.when(told.rlike("24u|altijd open"), "Vrij"),
        "honden_toegestaan": F.when(told.contains("honden welkom"), "Ja"),
    }
    return df.withColumns(
        {
            c: F.when(_unknown(F.col(c)), F.coalesce(v, F.col(c))).otherwise(F.col(c)) for c,
            v in facts.items() if c in df.columns
        }
    )


def crowding_by_capacity(c: Column) -> Column:
    """E9."""
    n = c.try_cast("int")
    return F.when(n < 20, "Snel vol in het seizoen").when(n > 50, "Vaak plek beschikbaar").otherwise(UNKNOWN)


def domain_errors(df: DataFrame) -> Column:
    """The columns whose value the contract of answers doesn't allow, in its order; null is never allowed."""

    def allowed(name: str) -> Column:
        c = F.col(name)
        if name in DOMAINS:
            return c.isin(*DOMAINS[name])
        if name in SHAPES:
            return c.rlike(f"^(?:{SHAPES[name]}|Onbekend)\\z")
        if name in SPANS:
            low, high = SPANS[name]
            return (c == UNKNOWN) | F.size(F.regexp_extract_all(c, F.lit(r"\S+"), 0)).between(low, high)
        return F.trim(c) != ""

    bad = [F.when(~F.coalesce(allowed(c), F.lit(False)), c) for c in ENRICHED if c in df.columns]
    return F.array_join(F.array_compact(F.array(*bad)), ",")


def _called(pool: ThreadPoolExecutor, fetch: Callable[[str], str], values: list, timeout_s: float) -> list[tuple[str, str | None]]:
    """(text, error) of as many calls at once as the pool has threads; what isn't back in time is an error."""
    calls = [pool.submit(fetch, value) for value in values]
    wait(calls, timeout=timeout_s)
    out = []
    for call in calls:
        if not call.done():
            call.cancel()
            out.append(("", f"no answer within {timeout_s:g} s"))
        elif (failure := call.exception()) is not None:  # a client's failure belongs to its row
            out.append(("", str(failure)))
        else:
            out.append((call.result(), None))
    return out


def fetched(
    df: DataFrame, fetch: Callable[[str], str], column: str = "url", workers: int = 10, timeout_s: float = 18.0
) -> DataFrame:
    """An injected client over batches of rows, ``workers`` calls at once in each task.

    Adds site_text and error. A row whose call fails or takes longer than
    ``timeout_s`` has an empty text and says so; the other rows go on. A call
    that hangs keeps its thread, and the next calls get new ones.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pool, got, values = ThreadPoolExecutor(workers), [], frame[column].tolist()
            for at in range(0, len(values), workers):
                now = _called(pool, fetch, values[at : at + workers], timeout_s)
                got += now
                if any(e and e.startswith("no answer within") for _, e in now):
                    pool.shutdown(wait=False, cancel_futures=True)
                    pool = ThreadPoolExecutor(workers)
            pool.shutdown(wait=False)
            yield frame.assign(site_text=[t for t, _ in got], error=pd.Series([e for _, e in got], index=frame.index, dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, site_text string, error string")


def _answers(asked: DataFrame, answer: Callable[[str], str], shape: str, *keep: str) -> DataFrame:
    """What an injected model answers to each prompt, parsed; null where it isn't JSON of that shape."""
    said = fetched(asked, answer, "prompt", workers=1, timeout_s=600.0)  # a model is asked one by one, and retries itself
    return said.select(*keep, F.from_json(first_json(F.col("site_text")), shape).alias("r"))


def batch_run(
    base: DataFrame, scraped: DataFrame, answer: Callable[[str], str], answer_again: Callable[[str], str],
    columns: list[str], limit: int = 0, size: int = 5
) -> DataFrame:
    """What a run of the model makes of the unprocessed rows, a row each.

    ``scraped`` has place_id, site_text, changed, total_len and photos (a list);
    a row that isn't there counts as changed and empty. Unprocessed rows go in
    batches of ``size``; of a batch, rows that are unchanged and checked before
    are skipped, and the others make one prompt. Its answer is a JSON list,
    paired with the rows by position; rows it doesn't cover stay as they are.
    Where little text was found or much is still unknown, a second prompt for
    that row alone is answered by ``answer_again``, and fills unknown values
    only. Result: place_id, skipped, fallback, succeeded, the columns, photos.
    """
    own = list(
        dict.fromkeys(["place_id", *[c for c in ("naam", "provincie") if c in base.columns], *columns, "ai_gecheckt"])
    )
    todo = numbered(first_unprocessed(base, limit).select(*own), size=size).drop("position")
    known = scraped.select("place_id", "site_text", "changed", "total_len", "photos")
    todo = todo.join(known, "place_id", "left").withColumns(
        {"changed": F.coalesce("changed", F.lit(True)), "total_len": F.coalesce("total_len", F.lit(0))}
    )
    todo = filed(todo.withColumn("skipped", unchanged()), "todo")
    place = Window.partitionBy("batch").orderBy("place_id")  # a batch of at most ``size``
    asked = todo.filter("not skipped").withColumn("pos", (F.row_number().over(place) - 1).cast("int"))
    shape = "struct<" + ", ".join(f"{c}: string" for c in columns) + ">"
    # models are asked once: what they said is written before it is used twice
    answers = filed(_answers(prompts(asked, columns), answer, f"array<{shape}>", "batch"), "answers")
    got = paired(
        asked, answers.select("batch", F.col("r").alias("items")).filter("items is not null")
    ).filter("item is not null")
    named = F.concat_ws(", ", *[c for c in ("naam", "provincie") if c in base.columns])
    got = got.select("place_id", named.alias("named"), "total_len", "photos", "item")
    unknown = lambda row: F.size(
        F.filter(F.array(*[row[c] for c in columns]), lambda v: F.coalesce(_unknown(v), F.lit(False)))
    )
    got = got.withColumn("fallback", (F.col("total_len") < SHORT_TEXT) | (unknown(F.col("item")) > MANY_UNKNOWN))
    lacking = F.array_join(F.array_compact(F.array(*[F.when(_unknown(F.col("item")[c]), c) for c in columns])), ", ")
    second = got.filter("fallback").select(
        "place_id",
        F.concat_ws(
            "\n", F.concat(F.lit("Zoek: "), F.col("named")), F.concat(F.lit("Onbekend: "), lacking),
            F.concat(F.lit("Data: "), F.to_json("item"))
        ).alias("prompt")
    )
    again = filed(_answers(second, answer_again, shape, "place_id"), "second")
    first = got.select("place_id", "fallback", "photos", "item.*")
    filled = fill_unknown(first, again.filter("r is not null").select("place_id", "r.*"), columns)
    shown = F.when(F.size("photos") > 0, F.to_json("photos"))
    done = postprocess(filled.withColumn("photos", shown)).withColumn("succeeded", F.lit(True))
    rest = todo.select("place_id", "skipped").join(done, "place_id", "left")
    return rest.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("fallback", "succeeded")})


def applied(base: DataFrame, run: DataFrame) -> DataFrame:
    """``base`` with the values of a run; rows with a result, and skipped ones, count as processed."""
    return upsert(base, values(run))


def values(run: DataFrame) -> DataFrame:
    """What a run's rows change: place_id and the columns, nulls where a row was skipped."""
    return run.filter("succeeded or skipped").drop("skipped", "fallback", "succeeded")


def enriched(base: DataFrame, scraped: DataFrame, answer: Callable[[str], str], columns: list[str]) -> DataFrame:
    """A run in batches of one, without a second pass: ``base`` with the answers for rows (place_id, site_text) to do."""
    pages = scraped.select(
        "place_id", "site_text", F.lit(True).alias("changed"), F.lit(SHORT_TEXT).alias("total_len"),
        F.lit(None).cast("array<string>").alias("photos")
    )
    return applied(base, batch_run(base, pages, answer, lambda _: "", columns, size=1).drop("photos"))
