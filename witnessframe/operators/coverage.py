"""Keyword coverage of recognised text across ordered passes.

reads     shot_id, seq, wave, text ...      one row per pass
keywords  shot_id, kw_pos, keyword          what each shot is expected to show
shots     shot_id, min_fraction             the stop rule

A keyword matches the text of passes 1..i joined by line breaks, so it may span
passes. Concatenating every prefix grows quadratically; instead tokens get one
running position per shot and keywords are looked up in that positional index by
equi-joins: the first pass whose tokens complete a keyword is where it starts to count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, norm_text, tokens
from ..functions.values import pass_defaults
from ..plans.ordered import Cuts, cuts, running
from ..plans.skew import join_unique, small_side
from ..session import durable

# Join keys are three characters of a token, or one where it is shorter.
GRAM = 3
WINDOW = 4
# Wanted grams that a token is tested against before it is split; beyond, all its grams are looked up.
MOST_GRAMS = 4096
# So many shots that are still read, with their keywords, are broadcast.
FEW_SHOTS = 1000


def _by(reads: DataFrame, chunk: Cuts | int | None) -> Cuts | Column:
    """Where shots with very many passes are cut: as counted, or every ``chunk`` passes."""
    if isinstance(chunk, int):
        return F.floor(F.col("seq") / chunk)
    return chunk or cuts(reads.select("shot_id", "seq"), ["shot_id"], ["seq"])


def token_stream(reads: DataFrame, chunk: Cuts | int | None = None) -> DataFrame:
    """Passes with their tokens, the running token position and the next pass's first token."""
    passes = reads.where(~blank(F.col("text"))).select("shot_id", "seq", tokens(F.col("text")).alias("toks"))
    head = F.struct(F.element_at("toks", 1).alias("tok"), F.col("seq").alias("seq"))
    placed = running(
        passes, ["shot_id"], ["seq"], _by(reads, chunk),
        sums={"end": F.size("toks").cast("bigint")}, following={"next": head},
    )
    return placed.withColumn("start", F.col("end") - F.size("toks"))


def _positions(stream: DataFrame) -> DataFrame:
    return stream.select("shot_id", "seq", "start", F.posexplode("toks").alias("i", "tok")).select(
        "shot_id", "seq", (F.col("start") + F.col("i")).alias("pos"), "tok"
    )


def _adjacent(stream: DataFrame) -> DataFrame:
    """(tok, following tok) pairs by position, also across pass borders."""
    here = F.transform("toks", lambda t: F.struct(t.alias("tok"), F.col("seq").alias("seq")))
    chain = F.when(F.col("next").isNotNull(), F.concat(here, F.array("next"))).otherwise(here)
    pairs = F.arrays_zip(F.slice(chain, F.lit(1), F.size(chain) - 1).alias("a"), F.slice(chain, F.lit(2), F.size(chain) - 1).alias("b"))
    return stream.select("shot_id", "start", F.posexplode(pairs).alias("i", "p")).select(
        "shot_id", (F.col("start") + F.col("i")).alias("pos"),
        F.col("p.a.tok").alias("tok"), F.col("p.b.tok").alias("after"), F.col("p.b.seq").alias("seq"),
    )


def _reach(tok: Column) -> Column:
    return F.when(F.length(tok) >= GRAM, F.lit(GRAM)).otherwise(F.lit(1))


def _grams(tok: Column) -> Column:
    """Distinct substrings of one and of GRAM characters."""

    def of(q):
        starts = F.sequence(F.lit(1), F.greatest(F.length(tok) - q + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(tok, i, F.lit(q)))

    return F.array_distinct(F.concat(of(1), of(GRAM)))


def _inside_tokens(stream: DataFrame, phrases: DataFrame, keys: list[str], extent: tuple[int, int]) -> DataFrame:
    """Phrases of one token inside the tokens of a shot, each looked up by its first gram.

    Which grams any phrase has is counted first. While they are few, a token is split into those alone, so a gram that no phrase has is never
    exploded.
    """
    vocabulary = stream.select("shot_id", "seq", F.explode(F.array_distinct("toks")).alias("tok")).groupBy("shot_id", "tok").agg(F.min("seq").alias("seq"))
    one = phrases.select(*keys, "phrase", F.left("phrase", _reach(F.col("phrase"))).alias("gram"))
    wanted = [r[0] for r in one.select("gram").distinct().limit(MOST_GRAMS + 1).collect()]
    grams = _grams(F.col("tok"))
    grams = F.filter(grams, lambda g: g.isin(wanted)) if len(wanted) <= MOST_GRAMS else grams
    words = vocabulary.select("shot_id", "tok", "seq", F.explode(grams).alias("gram"))
    return words.join(small_side(one, *extent), [*keys, "gram"]).where(F.col("tok").contains(F.col("phrase"))).select("shot_id", "phrase", "seq")


def _begun(stream: DataFrame, phrases: DataFrame, keys: list[str], sizes: list[tuple[int, int]], extent: tuple[int, int]) -> DataFrame:
    """Places where the first two tokens of a phrase match.

    A phrase starts inside or at the end of a token and goes on at the start of the next
    one; characters on both sides of that space are the join key. ``sizes`` lists the key
    lengths in use, at most four, so a place is tried at most four times.
    """
    first, second = F.get("want", F.lit(0)), F.get("want", F.lit(1))
    wanted = phrases.select(*keys, "phrase", "want", "k", F.right(first, _reach(first)).alias("left"), F.left(second, _reach(second)).alias("right"))
    ends = F.array(*[F.struct(F.right("tok", F.lit(a)).alias("left"), F.left("after", F.lit(b)).alias("right")) for a, b in sizes])
    spots = _adjacent(stream).withColumn("t", F.explode(F.array_distinct(ends))).select("shot_id", "pos", "seq", "tok", "after", "t.*")
    return spots.join(small_side(wanted, *extent), [*keys, "left", "right"]).where(
        F.endswith("tok", first) & F.when(F.col("k") == 2, F.startswith("after", second)).otherwise(F.col("after") == second)
    )


def phrase_hits(reads: DataFrame, phrases: DataFrame, keys: list[str], chunk: Cuts | int | None = None) -> DataFrame:
    """Earliest pass completing each phrase: (shot_id, phrase, seq).

    ``phrases`` holds distinct normalized ``phrase`` texts per ``keys`` (``["shot_id"]``,
    or ``[]`` for phrases looked up in every shot).
    """
    parts = phrases.withColumn("want", F.split("phrase", " ")).withColumn("k", F.size("want"))
    shape = [F.least(F.col("k"), F.lit(3)).alias("k")] + [
        _reach(F.get("want", F.lit(i))).alias(f"q{i}") for i in (0, 1)
    ]
    # Which kinds of phrase there are: at most a dozen rows, whatever the data.
    kinds = [
        (r.k, r.q0, r.q1, r.n, r.size)
        for r in parts.groupBy(*shape).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("phrase") * 3 + 64).alias("size")).collect()
    ]
    extent = (sum(kind[3] for kind in kinds), sum(kind[4] for kind in kinds))
    sizes = sorted({(a, b) for k, a, b, *_ in kinds if k > 1})
    found = []
    # Every text is split into tokens once; places, pairs and vocabulary come from there.
    stream = durable(token_stream(reads, chunk)) if sizes else reads.where(~blank(F.col("text"))).select("shot_id", "seq", tokens(F.col("text")).alias("toks"))
    if any(kind[0] == 1 for kind in kinds):
        found.append(_inside_tokens(stream, parts.where("k = 1"), keys, extent))
    if sizes:
        begun = _begun(stream, parts.where("k > 1"), keys, sizes, extent)
        found.append(begun.where("k = 2").select("shot_id", "phrase", "seq"))
        if any(kind[0] > 2 for kind in kinds):
            rest = begun.where("k > 2").select(
                "shot_id", "phrase", "k", F.col("pos").alias("from"), F.posexplode(F.slice("want", F.lit(3), F.greatest(F.col("k") - 2, F.lit(0)))).alias("i", "word")
            ).select("shot_id", "phrase", "k", "from", (F.col("from") + F.col("i") + 2).alias("pos"), "word", (F.col("i") == F.col("k") - 3).alias("last"))
            followed = rest.join(_positions(stream), ["shot_id", "pos"]).where(
                F.when(F.col("last"), F.startswith("tok", F.col("word"))).otherwise(F.col("tok") == F.col("word"))
            )
            found.append(
                followed.groupBy("shot_id", "phrase", "k", "from").agg(F.count(F.lit(1)).alias("found"), F.max("seq").alias("seq"))
                .where(F.col("found") == F.col("k") - 2).select("shot_id", "phrase", "seq")
            )
    if not found:
        return reads.select("shot_id", F.lit("").alias("phrase"), "seq").where(F.lit(False))
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    return both.groupBy("shot_id", "phrase").agg(F.min("seq").alias("seq"))


def keyword_hits(reads: DataFrame, keywords: DataFrame, chunk: Cuts | int | None = None) -> DataFrame:
    """Every non-blank keyword in its original spelling with the first pass that shows it.

    ``first_seq`` is null for a keyword no pass completes; duplicates stay separate rows.
    """
    wanted = _wanted(keywords)
    return _first_seen(wanted, phrase_hits(reads, wanted.select("shot_id", "phrase").distinct(), ["shot_id"], chunk))


def _wanted(keywords: DataFrame) -> DataFrame:
    return keywords.where(~blank(F.col("keyword"))).withColumn("phrase", norm_text(F.col("keyword")))


def _first_seen(wanted: DataFrame, hits: DataFrame) -> DataFrame:
    return wanted.join(hits.withColumnRenamed("seq", "first_seq"), ["shot_id", "phrase"], "left").select(
        "shot_id", "kw_pos", "keyword", "first_seq"
    )


def _fresh(hits: DataFrame) -> DataFrame:
    """Keywords first shown by each pass."""
    return hits.where("first_seq is not null").groupBy("shot_id", F.col("first_seq").alias("seq")).agg(F.count(F.lit(1)).alias("fresh"))


def shot_levels(reads: DataFrame, hits: DataFrame, shots: DataFrame | None = None, chunk: Cuts | int | None = None) -> DataFrame:
    """One row per shot: n_reads, n_keywords and, given the stop rule, won_seq and final matched.

    The winning pass follows from the keyword hits alone, so no pass text is touched here.
    """
    counts = hits.groupBy("shot_id").agg(F.count(F.lit(1)).alias("n_keywords"))
    level = reads.groupBy("shot_id").agg(F.count(F.lit(1)).alias("n_reads"), F.min("seq").alias("first_read"))
    level = level.join(counts, "shot_id", "left").withColumn("n_keywords", F.coalesce("n_keywords", F.lit(0).cast("bigint")))
    if shots is None:
        return level
    level = level.join(shots, "shot_id")
    rising = running(_fresh(hits), ["shot_id"], ["seq"], _by(reads, chunk), sums={"matched": F.col("fresh")})
    rule = counts.join(shots, "shot_id")
    met = F.col("matched") / F.col("n_keywords") >= F.col("min_fraction")
    won = rising.join(rule, "shot_id").groupBy("shot_id").agg(
        F.min(F.when(met, F.struct("seq", "matched"))).alias("won"), F.max("matched").alias("all_matched")
    )
    level = level.join(won, "shot_id", "left")
    usable = F.col("n_keywords") > 0
    at_once = usable & (F.col("min_fraction") <= 0)  # met by the first pass, matched or not
    first_is_hit = F.col("won.seq") == F.col("first_read")
    matched = F.when(at_once & ~F.coalesce(first_is_hit, F.lit(False)), F.lit(0)).otherwise(
        F.coalesce("won.matched", "all_matched", F.lit(0))
    )
    return level.select(
        "shot_id", "n_reads", "n_keywords", "min_fraction",
        F.when(at_once, F.col("first_read")).otherwise(F.col("won.seq")).alias("won_seq"),
        F.when(usable, matched).alias("final_matched"),
    )


def pass_fractions(reads: DataFrame, keywords: DataFrame, chunk: Cuts | int | None = None) -> DataFrame:
    """Passes with ``matched`` (keywords shown so far), ``n_keywords`` and ``fraction``.

    A shot without usable keywords has a null fraction.
    """
    chunk = chunk if isinstance(chunk, int) else _by(reads, chunk)
    hits = durable(keyword_hits(reads, keywords, chunk))
    return _with_fractions(reads, hits, shot_levels(reads, hits, chunk=chunk), chunk)


def _with_fractions(passes: DataFrame, hits: DataFrame, level: DataFrame, chunk: int) -> DataFrame:
    known = join_unique(passes, level, ["shot_id"], "n_reads", ["seq"]).drop("n_reads", "first_read")
    known = known.join(_fresh(hits), ["shot_id", "seq"], "left")
    placed = running(
        known, ["shot_id"], ["seq"], _by(passes, chunk), sums={"matched": F.coalesce("fresh", F.lit(0)).cast("bigint")}
    ).drop("fresh")
    return placed.withColumn("fraction", F.when(F.col("n_keywords") > 0, F.col("matched") / F.col("n_keywords")))


def _allowed() -> Column:
    return F.when(F.col("won_seq").isNotNull(), F.col("seq") <= F.col("won_seq")).otherwise(
        (F.col("n_keywords") > 0) | (F.col("wave") == "passes")
    )


def passes_read(reads: DataFrame, keywords: DataFrame, shots: DataFrame, chunk: Cuts | int | None = None) -> DataFrame:
    """The passes an early-stopping reader performs, with ``won_seq`` of the shot.

    Reading stops with the first pass at or over the floor. The fallback wave follows
    only where keywords exist and stay unmet; without keywords every ordinary pass is read.
    """
    chunk = chunk if isinstance(chunk, int) else _by(reads, chunk)
    hits = durable(keyword_hits(reads, keywords, chunk))
    return _with_fractions(reads, hits, shot_levels(reads, hits, shots, chunk), chunk).where(_allowed())


def outcomes(reads: DataFrame, keywords: DataFrame, shots: DataFrame, chunk: Cuts | int | None = None) -> DataFrame:
    """One row per shot: winning pass, final coverage and how much was read."""
    chunk = chunk if isinstance(chunk, int) else _by(reads, chunk)
    hits = durable(keyword_hits(reads, keywords, chunk))
    level = shot_levels(reads, hits, shots, chunk)
    # every pass text is followed by one line break
    sized = reads.select("shot_id", "seq", "wave", (F.octet_length("text") + 1).cast("bigint").alias("bytes"))
    kept = join_unique(sized, level, ["shot_id"], "n_reads", ["seq"]).where(_allowed())
    usable = F.max("n_keywords") > 0
    return kept.groupBy("shot_id").agg(
        F.max("won_seq").alias("won_seq"),
        F.max_by("wave", "seq").alias("last_wave"),
        F.max("n_keywords").alias("n_keywords"),
        F.max("final_matched").cast("bigint").alias("matched"),
        F.when(usable, F.max("final_matched") / F.max("n_keywords")).alias("fraction"),
        F.when(usable, F.max("won_seq").isNotNull()).alias("met"),
        F.count(F.lit(1)).alias("passes_read"),
        F.sum("bytes").alias("text_bytes"),
    )


def pass_totals(kept: DataFrame) -> DataFrame:
    """Cost of the passes performed per shot."""
    return kept.groupBy("shot_id").agg(
        F.count(F.lit(1)).alias("passes_read"), F.sum("resample_ms").alias("resample_ms"), F.sum("ocr_ms").alias("ocr_ms"),
        F.sum("pixels").alias("pixels"), F.sum(F.octet_length("text") + 1).alias("text_bytes"),
    )


def read_until_met(planned: DataFrame, frames: DataFrame, reader, keywords: DataFrame, shots: DataFrame) -> DataFrame:
    """Read planned passes with a caller's text reader, one round per pass over the shots
    that still need it. A shot carries the keywords it has not shown yet and the last tokens before its next text from round to round, so a round
    touches neither earlier texts nor shots that are done.

    planned: shot_id, seq, wave, pass; frames: shot_id, image. ``reader(image, pass)``
    returns a text Column, usually an Arrow pandas UDF. There are as many rounds as passes in the
    longest request (a short list) that is not met before, and every round's texts are stored once.
    """
    wanted = durable(_wanted(keywords))
    before = (wanted.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1) - 1
    # A request is a short list, and so are its keywords.
    asked = wanted.groupBy("shot_id", "phrase").agg(F.count(F.lit(1)).alias("n")).groupBy("shot_id").agg(
        F.collect_list(F.struct("phrase", "n")).alias("pending"), F.sum("n").alias("n_keywords")
    )
    level = planned.select("shot_id").distinct().join(asked, "shot_id", "left").join(shots.select("shot_id", "min_fraction", F.lit(True).alias("ruled")), "shot_id", "left")
    # Without keywords there is no fallback.
    unkeyed = level.where("ruled and n_keywords is null").select("shot_id", F.lit("fallback").alias("wave"))
    reading = planned.where("seq >= 0").join(unkeyed, ["shot_id", "wave"], "left_anti")
    plan = durable(running(reading, ["shot_id"], ["seq"], _by(reading, None), sums={"place": F.lit(1).cast("bigint")}))
    active = durable(
        level.drop("ruled").join(plan.groupBy("shot_id").agg(F.count(F.lit(1)).alias("n_passes")), "shot_id").withColumn("tail", F.lit(""))
    )
    frames = durable(frames)
    stored = left = active.count()
    place, rounds = 0, []
    while left:
        place += 1
        few = F.broadcast if left <= FEW_SHOTS else lambda df: df
        due = plan.where(F.col("place") == place).drop("place").join(few(active), "shot_id")
        fresh = few(due).join(frames, "shot_id").withColumn("text", reader(F.col("image"), F.col("pass")))
        seen = fresh.withColumn("seen", norm_text(F.concat_ws(" ", "tail", "text")))
        toks = F.split("seen", " ")
        # A keyword that begins in an earlier pass needs no more of it than the last tokens.
        last = F.array_join(F.slice(toks, F.greatest(F.size(toks) - before + 1, F.lit(1)), F.lit(before)), " ") if before else F.lit("")
        step = seen.withColumns({"tail": last, "pending": F.filter("pending", lambda k: ~F.contains(F.col("seen"), k["phrase"]))})
        unshown = F.aggregate("pending", F.lit(0).cast("bigint"), lambda n, k: n + k["n"])
        met = F.coalesce((F.col("n_keywords") - unshown) / F.col("n_keywords") >= F.col("min_fraction"), F.lit(False))
        step = durable(step.select("shot_id", "seq", "wave", "text", "n_keywords", "min_fraction", "n_passes", "pending", "tail", met.alias("met")))
        rounds.append(step.select("shot_id", "seq", "wave", "text"))
        active = step.where(~F.col("met") & (F.col("n_passes") > place)).drop("seq", "wave", "text", "met")
        left = active.count()
        if left * 2 <= stored:
            # What is done is not scanned again.
            stored, ids = left, active.select("shot_id")
            plan = durable(plan.where(F.col("place") > place).join(ids, "shot_id", "left_semi"))
            frames = durable(frames.join(ids, "shot_id", "left_semi"))
    if not rounds:
        return planned.select("shot_id", "seq", "wave", F.lit(None).cast("string").alias("text")).limit(0)
    while len(rounds) > 1:  # pairwise, so that the plan of many rounds stays flat
        rounds = [a[0].unionByName(a[1]) if len(a) > 1 else a[0] for a in (rounds[i : i + 2] for i in range(0, len(rounds), 2))]
    return rounds[0]


def wave_reads(planned: DataFrame) -> DataFrame:
    """Explode planned ``passes`` and ``fallback`` arrays to one row per pass in reading order."""
    first = planned.select("shot_id", F.lit("passes").alias("wave"), F.posexplode("passes").alias("index", "pass"), F.lit(0).alias("before"))
    second = planned.select("shot_id", F.lit("fallback").alias("wave"), F.posexplode("fallback").alias("index", "pass"), F.size("passes").alias("before"))
    filled = pass_defaults(*[F.col(f"pass.{f}") for f in ("psm", "lang", "dpi", "scale", "pixel_budget")])
    return first.unionByName(second).select("shot_id", "wave", "index", (F.col("index") + F.col("before")).alias("seq"), filled.alias("pass"))


def containment(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the normalized document contains the normalized phrase.

    The inner tokens of a phrase are whole tokens in any match. Of phrases with at least
    four tokens the longest run of up to WINDOW inner ones is the join key, so only
    documents holding it are compared in full. Shorter phrases use the positional index.
    """
    docs = texts.select("doc_id", norm_text(F.col("text")).alias("doc"))
    items = durable(
        phrases.where(~blank(F.col("text"))).select("item_id", norm_text(F.col("text")).alias("phrase")).withColumn("want", F.split("phrase", " "))
    )

    # ``toks`` below is always a column of its own: inside a lambda an expression would be
    # evaluated again for every position.
    def windows(n: int, measure: bool = False) -> Column:
        def at(i):
            run = [F.get("toks", i + j) for j in range(n)]
            key = F.xxhash64(*run)
            return F.struct(sum((F.length(t) for t in run), F.lit(0)).alias("size"), key.alias("key")) if measure else key

        # Null, and so no row, where there are fewer tokens; a filter would normalize the text twice.
        return F.when(F.size("toks") >= n, F.transform(F.sequence(F.lit(0), F.size("toks") - n), at))

    inner = items.where(F.size("want") >= 4).select("item_id", F.slice("want", F.lit(2), F.greatest(F.size("want") - 2, F.lit(0))).alias("toks")).withColumn(
        "n", F.least(F.size("toks"), F.lit(WINDOW))
    )
    split = docs.select("doc_id", F.split("doc", " ").alias("toks"))
    sizes = {r.n: r["count"] for r in inner.groupBy("n").count().collect()}  # n is 2..WINDOW
    found = None
    for n, rows in sorted(sizes.items()):
        anchors = inner.where(F.col("n") == n).select("item_id", F.array_max(windows(n, True))["key"].alias("anchor"))
        held = split.select("doc_id", F.explode(F.array_distinct(windows(n))).alias("anchor"))
        pairs = held.join(small_side(anchors, rows), "anchor").select("doc_id", "item_id")
        found = pairs if found is None else found.unionByName(pairs)
    brief = items.where(F.size("want") < 4).select("item_id", "phrase")
    single = texts.select(F.col("doc_id").alias("shot_id"), F.lit(0).alias("seq"), "text")
    short = phrase_hits(single, brief.select("phrase").distinct(), []).join(brief, "phrase").select(F.col("shot_id").alias("doc_id"), "item_id")
    if found is None:
        return short
    candidates = durable(found.distinct().join(items.select("item_id", "phrase"), "item_id"))
    extent = candidates.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0)).alias("size")).first()
    # Only texts that have a candidate are normalized again, once each; a column that may be null would be tested for it on every text.
    again = F.coalesce(norm_text(F.col("text")), F.lit("")).alias("doc")
    held = texts.select("doc_id", "text").join(small_side(candidates.select("doc_id"), extent.n), "doc_id", "left_semi").select("doc_id", again)
    long = held.join(small_side(candidates, extent.n, extent.size), "doc_id").where(F.col("doc").contains(F.col("phrase"))).select("doc_id", "item_id")
    return long.unionByName(short)


# ---- word bags ----


def words(text: Column) -> Column:
    """Lower-case words: runs of letters, digits, ``$``, ``,`` and ``.`` with outer commas and stops removed."""
    parts = F.transform(F.split(text, "[^\\p{IsAlphabetic}\\p{N}$,.]+"), lambda w: F.regexp_replace(w, "^[,.]+|[,.]+$", ""))
    return F.transform(F.filter(parts, lambda w: w.rlike("[\\p{IsAlphabetic}\\p{N}]")), lambda w: F.lower(w))


def word_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.select(*keys, F.explode(words(F.col(text))).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def bag_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and word: copies in both bags, surplus of a, surplus of b."""
    both = a.withColumnRenamed("n", "n_a").join(b.withColumnRenamed("n", "n_b"), [*keys, "word"], "full_outer")
    n_a, n_b = F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))
    return both.select(
        *keys, "word", F.least(n_a, n_b).alias("common"), F.greatest(n_a - n_b, F.lit(0)).alias("only_a"),
        F.greatest(n_b - n_a, F.lit(0)).alias("only_b"),
    )


def bag_summary(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return bag_difference(a, b, keys).groupBy(*keys).agg(
        F.sum("common").alias("common_words"), F.sum("only_a").alias("only_a_words"), F.sum("only_b").alias("only_b_words")
    )
