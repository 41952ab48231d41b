"""Text quality rules, as column expressions only: repetition and length rules, and distribution divergence.

A text's histograms of character classes and of its language's common words are compared with the references of its
language by the Jensen-Shannon distance (base 2, 0 to 1). References are counted over all texts of a language; a
common word holds at least a thousandth of its language's words, so there are at most a thousand candidates, and the
most frequent of them are used. Short texts are not judged by a distance. Words that repeat are found inside a row:
each three-word window is a 64-bit number of the window's hash and its place, sorted; equal neighbours are repeats.

Defined results: a null text is an empty one: it has no words and fails the length rule; a null language is a language
of its own; equal rows give equal rows; a null doc_id is kept; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm import common

SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", "[#*$%&|<>]"
CLASSES = ("lower", "upper", "digit", "space", "mark", "other")
#: Common words of a language that are compared, and the least share of its words that one holds.
COMMON_WORDS, LEAST_SHARE = 24, 0.001
#: Distances from which a text is rejected, and the words from which it is judged by them.
CLASS_DISTANCE, CLASS_WORDS = 0.25, 50
WORD_DISTANCE, WORD_WORDS = 0.31, 100
MIN_WORDS, REPEAT_PERCENT = 50, 50


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _language() -> Column:
    return F.coalesce(F.concat(F.lit("l"), F.col("lang").cast("string")), F.lit("null"))


def common_words(docs: DataFrame) -> dict[str, list[tuple[str, float]]]:
    """For each language its most frequent words and their shares of all its words."""
    words = docs.select(_language().alias("language"), F.explode(words_of(F.col("text"))).alias("word"))
    counted = common.store(words.groupBy("language", "word").agg(F.count("*").alias("n")), "words")
    totals = counted.groupBy("language").agg(F.sum("n").alias("total"))
    frequent = counted.join(F.broadcast(totals), "language").filter(F.col("n") >= F.col("total") * LEAST_SHARE)  # a row per language; at most 1,000 words each are left
    order = Window.partitionBy("language").orderBy(F.desc("n"), "word")
    found: dict[str, list[tuple[str, float]]] = {}
    top = frequent.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= COMMON_WORDS)
    for r in top.orderBy("language", "rank").collect():
        found.setdefault(r["language"], []).append((r["word"], r["n"] / r["total"]))
    return found


def measures(docs: DataFrame, references: dict[str, list[tuple[str, float]]]) -> DataFrame:
    """doc_id, language, the base counts, the character classes and how often each common word of the language occurs."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", _language().alias("language"), text.alias("text"))
    rows = rows.select("*", words_of(F.col("text")).alias("words"))
    rows = rows.select("*", F.size("words").cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")).alias("spaced"))
    # letters go first, so what the other classes are counted in is short
    rows = rows.select("*", F.regexp_replace("spaced", r"[\x20\p{Ll}]+", "").alias("no_lower"))
    rows = rows.select("*", F.regexp_replace("no_lower", r"\p{Lu}+", "").alias("no_upper"))
    rows = rows.select("*", F.regexp_replace("no_upper", r"\p{Nd}+", "").alias("no_digit"))
    rows = rows.select("*", F.regexp_replace("no_digit", r"[.,;:!?'\"()-]+", "").alias("no_mark"))
    in_words = F.length("spaced") - 2 * F.greatest(F.col("n_words"), F.lit(1))
    size = lambda c: F.length(c)
    counts = {
        "lower": in_words - size("no_lower"), "upper": size("no_lower") - size("no_upper"), "digit": size("no_upper") - size("no_digit"),
        "space": F.length("text") - in_words, "mark": size("no_digit") - size("no_mark"), "other": size("no_mark"),
    }
    symbols = size("no_mark") - F.length(F.regexp_replace("no_mark", SYMBOLS, ""))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    # most words are none of the common ones; what is left is short enough to be searched for each
    every = sorted({w for words in references.values() for w, _ in words})
    rows = rows.select("*", (F.filter("words", lambda w: w.isin(every)) if every else F.array().cast("array<string>")).alias("frequent"))
    looked_up = of_language({language: [w for w, _ in words] for language, words in references.items()}, "array<string>")
    occurrences = F.transform(looked_up, lambda w: (F.size("frequent") - F.size(F.array_remove("frequent", w))).cast("long"))
    return rows.select(
        "doc_id", "language", "n_words", in_words.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), *(v.cast("long").alias(k) for k, v in counts.items()),
        occurrences.alias("occurrences"), "words",
    )


def with_repeats(rows: DataFrame) -> DataFrame:
    """Replaces `words` by n_repeat_words: the words in three-word windows that occur twice or more."""
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.select("*", hashes.alias("h")).drop("words")
    windows = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2))))
    rows = rows.select("*", windows.alias("w")).drop("h")
    # as many low bits as places need, the rest for the hash; equal rests are checked with the whole hash. Texts whose
    # windows all differ, most of them, need none of this
    last = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n_words"), F.lit(2))))).cast("long") - 1
    rows = rows.select("*", last.alias("mask"), (F.size(F.array_distinct("w")) < F.size("w")).alias("some"))
    place = lambda v: v.bitwiseAND(F.col("mask"))
    packed = F.transform("w", lambda h, i: h.bitwiseAND(F.bitwise_not("mask")).bitwiseOR(i.cast("long")))
    rows = rows.select("*", F.when(F.col("some"), F.sort_array(packed)).alias("sorted"))

    def with_next(v: Column, k: Column) -> Column:
        following = F.get("sorted", k + 1)
        alike = (v.bitwiseXOR(following).bitwiseAND(F.bitwise_not("mask")) == 0) & (F.get("w", place(v).cast("int")) == F.get("w", place(following).cast("int")))
        return F.coalesce(alike, F.lit(False))

    rows = rows.select("*", F.transform("sorted", with_next).alias("again"))
    either = lambda v, k: F.when(F.get("again", k) | F.coalesce(F.get("again", k - 1), F.lit(False)), place(v).cast("int"))
    repeated = F.filter(F.transform("sorted", either), lambda p: p.isNotNull())
    rows = rows.select("*", F.sort_array(repeated).alias("at")).drop("sorted", "w", "again", "some")
    covered = F.aggregate(
        "at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda done, p: F.struct((done["n"] + F.least(F.lit(3), p - done["last"])).alias("n"), p.alias("last")), lambda done: done["n"],
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at", "mask")


def of_language(values: dict[str, list], kind: str) -> Column:
    """The value of the row's language; languages are few."""
    if not values:
        return F.lit(None).cast(kind)
    pairs = [x for language, items in values.items() for x in (F.lit(language), F.array(*map(F.lit, items)).cast(kind))]
    return F.try_element_at(F.create_map(*pairs), F.col("language"))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two histograms of equal length."""

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) / 2 + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0) / 2

    return F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda a, x: a + x)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept."""
    common.prepare(docs.sparkSession)
    references = common_words(docs)
    rows = common.store(with_repeats(measures(docs, references)), "measures")
    sums = rows.groupBy("language").agg(*(F.sum(c).cast("double").alias(c) for c in CLASSES)).collect()  # a row per language
    classes = {r["language"]: [r[c] / max(1.0, sum(r[c] for c in CLASSES)) for c in CLASSES] for r in sums}
    words = {language: [*(q for _, q in found), max(0.0, 1.0 - sum(q for _, q in found))] for language, found in references.items()}
    held = F.array(*(F.col(c).cast("double") for c in CLASSES))
    rows = rows.select("*", held.alias("by_class"), F.greatest(sum(F.col(c) for c in CLASSES), F.lit(1)).cast("double").alias("chars"))
    rows = rows.select("*", F.greatest(F.col("n_words"), F.lit(1)).cast("double").alias("many"))
    shares = F.transform("occurrences", lambda n: n / F.col("many"))
    rows = rows.select("*", shares.alias("shares"))
    rest = F.greatest(1.0 - F.aggregate("shares", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    by_class = divergence(F.transform("by_class", lambda n: n / F.col("chars")), of_language(classes, "array<double>"))
    by_word = divergence(F.concat("shares", F.array(rest)), of_language(words, "array<double>"))
    distance = lambda d: F.round(F.sqrt(F.greatest(d, F.lit(0.0))), 6)
    rows = rows.select("*", distance(by_class).alias("class_distance"), distance(by_word).alias("word_distance"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    far = ((F.col("n_words") >= CLASS_WORDS) & (F.col("class_distance") > CLASS_DISTANCE)) | ((F.col("n_words") >= WORD_WORDS) & (F.col("word_distance") > WORD_DISTANCE))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"), "class_distance", "word_distance",
    )


_COUNTED = ", ".join(f"sum({c})::double as {c}" for c in CLASSES)
_JS = """list_sum(list_transform(range(1, len({p}) + 1), lambda i:
    case when {p}[i] > 0 then {p}[i] * log2({p}[i] / (({p}[i] + {q}[i]) / 2)) else 0.0 end / 2
    + case when {q}[i] > 0 then {q}[i] * log2({q}[i] / (({p}[i] + {q}[i]) / 2)) else 0.0 end / 2))"""
ORACLE = rf"""
with d as (
  select doc_id, coalesce('l' || lang, 'null') as language, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda w: w <> '') as words from documents),
m as (
  select doc_id, language, text, words, len(words)::bigint as n_words, array_to_string(words, '') as joined,
    list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^ 	-
]')) as lines from d),
c as (
  select doc_id, language, words, n_words, length(joined)::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    length(joined) - length(regexp_replace(joined, '\p{{Ll}}', '', 'g')) as lower, length(joined) - length(regexp_replace(joined, '\p{{Lu}}', '', 'g')) as upper,
    length(joined) - length(regexp_replace(joined, '\p{{Nd}}', '', 'g')) as digit, length(text) - length(joined) as space,
    length(joined) - length(regexp_replace(joined, '[.,;:!?''"()-]', '', 'g')) as mark,
    length(regexp_replace(joined, '[\p{{Ll}}\p{{Lu}}\p{{Nd}}.,;:!?''"()-]', '', 'g')) as other from m),
w as (select doc_id, unnest(range(1, n_words - 1)) as i,
    unnest(list_transform(range(1, n_words - 1), lambda i: words[i] || chr(1) || words[i + 1] || chr(1) || words[i + 2])) as three from m where n_words >= 3),
v as (select doc_id, i, count(*) over (partition by doc_id, three) as again from w),
r as (select doc_id, count(distinct p)::bigint as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from v where again > 1) group by 1),
f as (select language, word, count(*) as n from (select language, unnest(words) as word from m) group by all),
t as (select language, sum(n) as total from f group by 1),
k as (select language, word, n / total as q, row_number() over (partition by language order by n desc, word) as place from f join t using (language) where n >= total * {LEAST_SHARE}),
common as (select language, list(word order by place) as common_words, list(q order by place) as shares from k where place <= {COMMON_WORDS} group by 1),
s as (select language, {_COUNTED} from c group by 1),
q as (select language, list_transform([{', '.join(CLASSES)}], lambda x: x / greatest(1.0, {' + '.join(CLASSES)})) as class_q from s),
p as (
  select c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, class_q,
    list_transform([{', '.join('c.' + x for x in CLASSES)}], lambda x: x / greatest(1, {' + '.join('c.' + x for x in CLASSES)})::double) as class_p,
    list_append(shares, greatest(0.0, 1.0 - list_sum(shares))) as word_q,
    list_transform(common_words, lambda x: len(list_filter(words, lambda y: y = x)) / greatest(1, n_words)::double) as held
  from c left join r on r.doc_id = c.doc_id left join q on q.language = c.language left join common on common.language = c.language),
j as (
  select *, list_append(held, greatest(0.0, 1.0 - list_sum(held))) as word_p, n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed from p),
e as (
  select *, round(sqrt(greatest(0.0, {_JS.format(p='class_p', q='class_q')})), 6) as class_distance,
    round(sqrt(greatest(0.0, {_JS.format(p='word_p', q='word_q')})), 6) as word_distance from j)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance,
  not base_failed and not coalesce((n_words >= {CLASS_WORDS} and class_distance > {CLASS_DISTANCE}) or (n_words >= {WORD_WORDS} and word_distance > {WORD_DISTANCE}), false) as kept
from e
"""
