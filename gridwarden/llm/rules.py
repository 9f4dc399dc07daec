"""Quality rules: repetition, and divergence from language references."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.llm.shared import alnum_words, bind, cut, space_words, whole

WINDOW = 8
#: Common words per language.
COMMON = 20
#: Characters and words below which a histogram says nothing, and words that a language's
#: reference is made of at least.
LEAST_CHARS, LEAST_WORDS, LEAST_REFERENCE = 200, 60, 2_000
#: Jensen-Shannon distances (0 to 1) beyond which a text is unlike every language; that of words
#: holds where a language has too few texts to show how far its own lie.
MOST_CHARS, MOST_WORDS = 0.27, 0.4
#: Spreads above the median of a language's own texts of that length that a text may lie. A
#: spread is taken from LEAST_TEXTS different ones at least, and is SCATTER / sqrt(words) at
#: least, half of what words drawn at random scatter.
SPREADS, LEAST_TEXTS, SCATTER = 4.0, 20, 0.15

#: Character classes; what is in none of them is one more. Most characters are of the first.
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{N}", r"\s", r".,;:!?'\"()-", r"#*$%&|<>")


def _without(text, pattern):
    return F.regexp_replace(text, f"[{pattern}]+", "")


def _count(text, pattern):
    return F.char_length(text) - F.char_length(_without(text, pattern))


def class_counts(text):
    """Characters in each class and in none; the later ones are counted in what the first left."""
    def rest(left):
        counts = F.array(F.char_length(text) - F.char_length(left),
                         *[_count(left, c) for c in CLASSES[1:]])
        return bind(counts, lambda found: F.concat(found, F.array(
            F.char_length(text) - F.aggregate(found, F.lit(0), lambda a, b: a + b))))

    return bind(_without(text, CLASSES[0]), rest)


def repeated_words(words, window=WINDOW):
    """Words in windows that occur twice or more, the first occurrence included.

    Hashes tell texts without a repeat, most of them; for the rest the windows themselves are
    sorted and compared.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))

    def covered(sorted_windows):
        def at(i):
            return F.get(sorted_windows, i)["window"]

        places = F.sort_array(F.filter(F.transform(
            sorted_windows, lambda w, i: F.when(
                (w["window"] == at(i - 1)) | (w["window"] == at(i + 1)), w["at"])),
            lambda p: p.isNotNull()))
        state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, state, lambda s, p: F.struct(
            (s["n"] + F.least(F.lit(window), p + window - F.greatest(s["end"], p))).alias("n"),
            (p + window).alias("end")), lambda s: s["n"])

    exact = bind(words, lambda w: bind(F.sort_array(F.transform(starts, lambda i: F.struct(
        F.array_join(F.slice(w, i, window), " ").alias("window"), i.alias("at")))), covered))

    def again(runs, length):
        """Whether a window is there twice, by the hashes of all runs of ``length`` words: a
        longer run's is made of two of them. A text without a repeated half has no repeat."""
        if length == window:
            return F.size(F.array_distinct(runs)) < F.size(runs)
        longer = min(2 * length, window)
        pairs = F.transform(F.sequence(F.lit(0), F.size(words) - longer), lambda i: F.xxhash64(
            F.get(runs, i), F.get(runs, i + (longer - length))))
        if longer == window or 2 * longer < window:
            return bind(pairs, lambda more: again(more, longer))
        return bind(pairs, lambda more: (F.size(F.array_distinct(more)) < F.size(more))
                    & again(more, longer))

    repeats = bind(F.transform(words, lambda w: F.xxhash64(w)), lambda runs: again(runs, 1))
    return F.when(F.size(words) <= window, 0).when(repeats, exact).otherwise(0)


def language_references(docs: DataFrame, common=COMMON):
    """Histograms of each language, from all documents that name one.

    Returns (words, {lang: (class shares, word shares)}, rare): the ``common`` most frequent
    words of every language together, and each language's share of them and, last, of all other
    words. Languages with fewer than LEAST_REFERENCE words are in rare alone, which holds their
    words, class shares and word shares, the two lists without those of a language too short to
    tell. Only these figures, a few hundred numbers a language, reach the driver.
    """
    named = docs.where("lang is not null").select("lang", whole(F.col("text")).alias("text"))
    counted = cut(named.select("lang", F.explode(alnum_words(F.col("text"))).alias("word"))
                  .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    sums = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).where(
        F.col("n") >= LEAST_WORDS).collect()}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= common).collect()

    def histograms(total):
        words = sorted({r.word for r in top if r.lang in total})
        met = counted.where(F.col("word").isin(words) & F.col("lang").isin(list(total))) \
            .collect() if words else []
        shares = {lang: dict.fromkeys(words, 0.0) for lang in sorted(total)}
        for r in met:
            shares[r.lang][r.word] = r.n / total[r.lang]
        return words, {lang: [*mine.values(), max(0.0, 1 - sum(mine.values()))]
                       for lang, mine in shares.items()}

    counts = named.select("lang", class_counts(F.col("text")).alias("n")).groupBy("lang").agg(
        F.array(*[F.sum(F.col("n")[i]) for i in range(len(CLASSES) + 1)]).alias("n")).collect()
    classes = {r.lang: [n / max(sum(r.n), 1) for n in r.n] for r in counts}
    words, known = histograms({k: n for k, n in sums.items() if n >= LEAST_REFERENCE})
    rare_words, rare = histograms({k: n for k, n in sums.items() if n < LEAST_REFERENCE})
    rare_classes = [classes[r.lang] for r in sorted(counts, key=lambda r: r.lang)
                    if r.lang not in known and sum(r.n) >= LEAST_CHARS]
    return (words, {lang: (classes[lang], mine) for lang, mine in known.items()},
            (rare_words, rare_classes, list(rare.values())))


def shares(counts, total):
    return bind(total, lambda all_: F.transform(counts, lambda n: n / all_))


def distance(mine, reference):
    """Jensen-Shannon distance, to base 2, of two histograms' shares."""
    def part(p, q):
        twice = p + q
        return (F.when(p > 0, p * F.log2(2 * p / twice)).otherwise(0.0)
                + F.when(q > 0, q * F.log2(2 * q / twice)).otherwise(0.0)) / 2

    if isinstance(reference, list):
        reference = F.array(*map(F.lit, reference))
    parts = F.zip_with(mine, reference, part)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)))


def least_distance(mine, references):
    """The distance to the nearest of a list of references, of which there may be many."""
    every = F.array(*[F.array(*map(F.lit, r)) for r in references])
    return F.array_min(F.transform(every, lambda reference: distance(mine, reference)))


def word_counts(found, words):
    """How often each of ``words`` is in the array, and how many others there are."""
    common = F.filter(found, lambda w: w.isin(words))
    each = bind(common, lambda c: bind(F.array_distinct(c), lambda once: F.transform(
        F.array(*map(F.lit, words)), lambda w: F.when(
            F.array_contains(once, w), F.size(c) - F.size(F.array_remove(c, w))).otherwise(0))))
    return bind(each, lambda n: F.concat(n, F.array(
        F.size(found) - F.aggregate(n, F.lit(0), lambda a, b: a + b))))


def length_class(n):
    """Number of the half-octave of word counts, from LEAST_WORDS on, that ``n`` is in."""
    return F.floor(2 * F.log2(n / LEAST_WORDS)).cast("int")


def word_limits(measured: DataFrame):
    """{lang: limits of the word distance, by length class}, from all of ``measure``'s rows.

    A limit is the median distance of the texts that name the language and are nearest to it,
    and SPREADS times their spread, which the lower half tells: what does not belong there is in
    the upper one. Equal distances, as of copies, count once. Longer texts scatter less, so a
    class of too few texts takes the limit of the next shorter one that has enough, and
    MOST_WORDS without one; no limit is above it. A few dozen figures a language reach the
    driver.
    """
    own = measured.where(~F.col("base_failed") & (F.col("lang") == F.col("word_lang"))).select(
        "lang", length_class(F.col("n_alnum")).alias("class"), "word_distance").distinct()
    found = own.groupBy("lang", "class").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("word_distance", [0.25, 0.5]).alias("q")).collect()
    limits = {}
    for lang in sorted({r.lang for r in found}):
        mine = {r["class"]: r for r in found if r.lang == lang}
        row = []
        for at in range(max(mine) + 1):
            limit = row[-1] if row else MOST_WORDS
            if at in mine and mine[at].n >= LEAST_TEXTS:
                low, middle = mine[at].q
                least = SCATTER / (LEAST_WORDS * 2 ** (at / 2)) ** 0.5
                # a quarter of a normal distribution lies 0.6745 of its spread below the median
                # and the figure for it, from n values, has a standard error of 1.8 / sqrt(n) of it
                spread = (middle - low) / 0.6745 * (1 + 1.8 / mine[at].n ** 0.5)
                limit = min(MOST_WORDS, middle + SPREADS * max(least, spread))
            row.append(limit)
        limits[lang] = row
    return limits


def measure(docs: DataFrame, references=None) -> DataFrame:
    """docs with all figures that ``judge`` adds but the verdict, and with n_alnum and word_lang,
    the count of the words in the histogram and the language with a reference that it is nearest
    to."""
    words, languages, (rare_words, rare_classes, rare) = references or language_references(docs)
    text = whole(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    figures = bind(space_words(text), lambda words: F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        repeated_words(words).cast("bigint").alias("n_repeat_words")))
    judged = docs.withColumn("_figures", figures).withColumns({
        "n_words": F.col("_figures.n_words"),
        "word_chars": F.col("_figures.word_chars"),
        "n_symbols": _count(text, "#*$%&|<>").cast("bigint"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        .cast("bigint"),
        "n_repeat_words": F.col("_figures.n_repeat_words"),
    }).drop("_figures").withColumn("base_failed", (F.col("n_words") < 20)
                  | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    if not languages:
        far = {"char_distance": F.lit(None).cast("double"), "n_alnum": F.lit(None).cast("int"),
               "_near": F.lit(None).cast("struct<far:double,lang:string>")}
    else:
        lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
        told = lang.isNull() | lang.isin(list(languages))

        def least(values):
            return F.array_min(F.array(*values))

        def near_chars(mine):
            far = [distance(mine, c) for c, _ in languages.values()]
            if rare_classes:
                far.append(F.when(lang.isNull(), least_distance(mine, rare_classes)))
            return least(far)

        def near_words(found):
            known = bind(shares(word_counts(found, words), F.size(found)), lambda mine: least(
                [F.struct(distance(mine, w).alias("far"), F.lit(name).alias("lang"))
                 for name, (_, w) in languages.items()]))
            if not rare:
                return known
            other = bind(shares(word_counts(found, rare_words), F.size(found)),
                         lambda mine: F.struct(least_distance(mine, rare).alias("far"),
                                               F.lit(None).cast("string").alias("lang")))
            return least([known, F.when(lang.isNull(), other)])

        chars = bind(shares(class_counts(text), F.char_length(text)), near_chars)
        common = bind(alnum_words(text), lambda found: F.struct(
            F.size(found).alias("n"),
            F.when(told & (F.size(found) >= LEAST_WORDS), near_words(found)).alias("near")))
        judged = judged.withColumn("_common", common)
        far = {"char_distance": F.when(told & (F.char_length(text) >= LEAST_CHARS), chars),
               "n_alnum": F.col("_common.n"), "_near": F.col("_common.near")}
    return judged.withColumns(far).withColumns({
        "word_distance": F.col("_near.far"), "word_lang": F.col("_near.lang"),
    }).drop("_common", "_near")


def verdict(measured: DataFrame, limits=None) -> DataFrame:
    """``measure``'s rows with kept; ``limits`` are those of the rows if not given."""
    limits = word_limits(measured) if limits is None else limits
    most = F.lit(MOST_WORDS)
    if limits:
        mine = F.create_map(*[x for lang, row in limits.items() for x in (
            F.lit(lang), F.array(*map(F.lit, row)))])[F.col("word_lang")]
        most = F.coalesce(F.get(mine, F.least(length_class(F.col("n_alnum")), F.size(mine) - 1)),
                          most)
    return measured.withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("char_distance", F.lit(0.0)) <= MOST_CHARS)
        & (F.coalesce("word_distance", F.lit(0.0)) <= most)).drop("n_alnum", "word_lang")


def judge(docs: DataFrame, references=None, limits=None) -> DataFrame:
    """docs with the rules' figures and verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (under 20
    words, or over 30 % of them repeated), char_distance and word_distance (to the nearest
    language reference; null for a text too short to tell, for one that names a language
    without a reference, or without references) and kept: the base rules hold and neither
    distance is too large, that of words for the nearest language and the text's length. A text
    that names no language may also be near to one of too few words for a reference, with
    MOST_WORDS as limit. Columns of these names, n_alnum and word_lang are replaced, the last two
    by none. A null text has no words and fails; no documents give no rows.

    ``references`` and ``limits`` are those of ``docs`` if not given; to find the limits,
    ``docs`` are read once more.
    """
    return verdict(measure(docs, references), limits)
