"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

*Base spans*: e-mail, IPv4, card and phone matches, leftmost and non-overlapping per kind; a match that
fails its check is dropped.  Patterns are possessive and anchored at the start of a run, which gives
the same matches in linear time.  Offsets come from the lengths of the matches and of what lies
between them.

*Method*: the values found are the protected entities, and so are the groups that they belong to (an
e-mail's domain, an address's /24 network, the first six digits of a card or phone number); a kind as
such protects nobody and is none.  A term (a whole word, outside the base spans) co-occurs with the
entities of its document, however far away.  Over the documents of the whole corpus,
PMI(t, e) = ln(n_te N / (n_t n_e)) says how much of the entity's information IC(e) = ln(N / n_e) the term
discloses.  A term discloses an entity when PMI / IC >= ``threshold`` and there is evidence: two or more different
texts with both whose number times PMI reaches ``evidence`` nats (however often one text repeats a term, it is
one text), or a tie to an e-mail address of the same text.  A term is tied when it is a part of the address before
the @ (three letters at least), or one of two adjacent capitalised words of which the address is made: both words,
the first one's initial and the second, or both initials.
 * In the entity's documents every occurrence of such a term is a span of kind ``term``.
 * Elsewhere too, in any document, if two or more different texts bear the evidence (texts * PMI reaches
   ``evidence``) and most documents with the term hold the entity.
A span is generalised to its class, or removed where PMI / IC >= ``remove_at``.

Sizes: entities of the same set of texts disclose alike and are paired once, so a text with many
addresses isn't multiplied by its words; the threshold bounds n_t by n_e, which drops a text's frequent
words before they are paired; pairs are summed in the tasks first.  Tables are broadcast while they have
at most ``broadcast_rows`` rows (counted), and meet in shuffle joins beyond.  Texts are named by 128 bits.

Null and empty texts have no spans; null ids are allowed; repeated rows have equal spans and are one
text of evidence; an empty table gives an empty result; other columns are never read, and ``sanitised``
carries them along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import Shelf, fresh, let, running_sums, table

#: The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP_OK = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
TERM = r"(?<![^\s(\[\"'])\p{L}[\p{L}\p{M}'-]*[\p{L}\p{M}](?![^\s.,;:!?)\]\"'])"
#: What a text must hold to have a base span at all.
_SIGNS = r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){13}|\+[0-9][ ().0-9-]{9}"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _matches(found: Column, gaps: Column) -> Column:
    """array of (start, value): each match and its offset, from what lies between the matches."""
    both = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("left"))
    starts = lambda pairs: running_sums(F.transform(pairs, lambda x: F.length(x["left"]) + F.length(x["m"])))
    return let(both, lambda pairs: F.zip_with(pairs, starts(pairs), lambda x, at: F.struct((at + F.length(x["left"])).alias("start"), x["m"].alias("value"))))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  the i-th from the right
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _valid(kind: int, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.rlike(value, F.lit(_IP_OK))
    if kind == 2:
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15)


_NONE = "array<struct<kind:int,start:int,end:int,entity:string,group:string>>"
_EXTRA = "array<struct<start:int,kind:int,end:int,removed:boolean>>"


def _spans(kind: int, matches: Column) -> Column:
    """The valid matches of a kind."""

    def span(m: Column) -> Column:
        entity = F.lower(m["value"]) if kind < 2 else F.regexp_replace(m["value"], "[^0-9]", "")
        group = F.substring_index(entity, "@", -1) if kind == 0 else F.substring_index(entity, ".", 3) if kind == 1 else F.substring(entity, 1, 6)
        return F.struct(
            F.lit(kind).alias("kind"),
            m["start"].alias("start"),
            (m["start"] + F.length(m["value"])).alias("end"),
            F.concat(F.lit(KINDS[kind] + ":"), entity).alias("entity"),
            F.concat(F.lit(KINDS[kind] + "/"), group).alias("group"),
        )

    return F.transform(F.filter(matches, lambda m: _valid(kind, m["value"])), span).cast(_NONE)


def _with_base(rows: DataFrame) -> DataFrame:
    """Adds ``spans``, the valid base spans of ``text``, and ``terms``, null where there are none of those.

    In steps, so that a pattern runs once over a text, and once more over those that it matches.
    """
    kinds = list(enumerate(((EMAIL, "@"), (IP, "."), (CARD, None), (PHONE, "+"))))
    none = F.array().cast("array<string>")
    seen = lambda pattern, sign: _found(F.col("text"), pattern) if sign is None else F.when(F.contains("text", F.lit(sign)), _found(F.col("text"), pattern)).otherwise(none)
    rows = rows.withColumns({f"m{k}": seen(pattern, sign) for k, (pattern, sign) in kinds})
    rows = rows.withColumns({f"g{k}": F.when(F.size(f"m{k}") > 0, F.split("text", pattern, -1)) for k, (pattern, _) in kinds})
    rows = rows.withColumns({f"s{k}": F.when(F.size(f"m{k}") > 0, _spans(k, _matches(F.col(f"m{k}"), F.col(f"g{k}")))).otherwise(F.array().cast(_NONE)) for k, _ in kinds})
    rows = rows.withColumn("spans", F.concat(*(f"s{k}" for k, _ in kinds)))
    rows = rows.withColumn("t", F.when(F.size("spans") > 0, _found(F.col("text"), TERM)))
    rows = rows.withColumn("tg", F.when(F.size("t") > 0, F.split("text", TERM, -1)))
    return rows.withColumn("terms", F.when(F.size("t") > 0, _terms(_matches(F.col("t"), F.col("tg")), F.col("s0"))))


def _terms(matches: Column, emails: Column) -> Column:
    """array of (term, start, end, capital), without the words in an e-mail's address; no other base span has letters."""
    first = lambda v: F.substring(v, 1, 1)
    named = F.transform(matches, lambda m: F.struct(F.lower(m["value"]).alias("term"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), (first(m["value"]) != F.lower(first(m["value"]))).alias("capital")))
    # a word begins after white space, a bracket or a quote, so it meets an address only where that begins
    return F.filter(named, lambda t: ~F.exists(emails, lambda e: (e["start"] >= t["start"]) & (e["start"] < t["end"])))


def _tied(spans: Column, terms: Column) -> Column:
    """array of (term, tied): whether a term is a part of an e-mail address of its text, or the address is made of it."""
    before_at = F.transform(F.filter(spans, lambda s: s["kind"] == 0), lambda s: F.substring_index(F.substring(s["entity"], len(KINDS[0]) + 2, F.length(s["entity"])), "@", 1))
    parts = F.filter(F.flatten(F.transform(before_at, lambda a: F.split(a, r"[^\p{L}]+"))), lambda p: F.length(p) >= 3)
    whole = F.transform(before_at, lambda a: F.regexp_replace(a, r"[^\p{L}]", ""))
    first = lambda t: F.substring(t["term"], 1, 1)

    def made_of(names: Column, a: Column, b: Column) -> Column:
        spelt = F.array(F.concat(a["term"], b["term"]), F.concat(first(a), b["term"]), F.concat(first(a), first(b)))
        return F.coalesce(a["capital"] & b["capital"] & (b["start"] - a["end"] <= 2) & F.arrays_overlap(spelt, names), F.lit(False))

    def judged(known: Column) -> Column:
        near = lambda i: F.get(terms, i)
        tied = lambda t, i: F.array_contains(known["parts"], t["term"]) | made_of(known["whole"], t, near(i + 1)) | made_of(known["whole"], near(i - 1), t)
        return F.transform(terms, lambda t, i: F.struct(t["term"].alias("term"), tied(t, i).alias("tied")))

    return let(F.struct(parts.alias("parts"), whole.alias("whole")), judged)


class Sanitiser:
    """Spans of a corpus; each table is computed once and kept in the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9, remove_at: float = 0.95, evidence: float = 10.0, broadcast_rows: int = 50_000):
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.threshold, self.remove_at, self.evidence, self.broadcast_rows = threshold, remove_at, evidence, broadcast_rows
        self.shelf = Shelf(docs.sparkSession)
        self.text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.col(id_col).cast("long").alias("id"), self.text.alias("text"))
        rows = _with_base(rows).select("id", F.md5("text").alias("th"), "spans", "terms")
        self.base = self.shelf.put(rows, "base")
        self._judge()

    def _few(self, df: DataFrame) -> DataFrame:
        """``df``, a written table, to be broadcast if it has at most ``broadcast_rows`` rows."""
        return F.broadcast(df) if df.count() <= self.broadcast_rows else df

    def _judge(self) -> None:
        """Writes ``added``, (th, extra): the spans of disclosing terms by text, and ``elsewhere``, those of texts without base spans."""
        shelf, kept = self.shelf, self.threshold
        n = self.base.count()
        names = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.array(s["entity"], s["group"]))))
        texts = self.base.where(F.size("spans") > 0).groupBy("th").agg(F.count("*").alias("copies"), F.first(names).alias("names"), F.first("terms").alias("terms"), F.first("spans").alias("spans"))
        texts = shelf.put(texts.withColumn("named", _tied(F.col("spans"), F.col("terms"))).drop("spans"), "texts")

        # entities of the same texts disclose alike: one name stands for all of them
        holds = texts.select("th", F.explode("names").alias("entity"), "copies")
        sign = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "th")).alias(f"sign{salt}")
        entities = holds.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts"), sign(1), sign(2))
        entities = shelf.put(entities.groupBy("n_e", "texts", "sign1", "sign2").agg(F.min("entity").alias("entity")).select("entity", "n_e"), "entities")
        holds = shelf.put(holds.join(self._few(entities), "entity"), "holds")
        largest = entities.agg(F.max("n_e")).first()[0] or 0

        # PMI / IC >= threshold means n_t <= n_te (N / n_e) ** (1 - threshold), and n_te <= n_e
        most = lambda n_e: F.pow(n_e.cast("double"), F.lit(kept)) * F.pow(F.lit(float(n)), F.lit(1 - kept)) * (1 + 1e-9)
        told = texts.select("th", "copies", F.inline("named")).groupBy("th", "copies", "term").agg(F.max("tied").alias("tied"))
        told = shelf.put(told, "told")
        rare = told.groupBy("term").agg(F.count("*").alias("texts"), F.max("tied").alias("tied"), F.sum("copies").alias("seen")).where(((F.col("texts") >= 2) | F.col("tied")) & (F.col("seen") <= most(F.lit(largest)))).select("term")
        rare = shelf.put(rare, "rare")
        if rare.isEmpty():
            self.added = self.elsewhere = shelf.put(texts.limit(0).select("th", F.array().cast(_EXTRA).alias("extra")), "added")
            return
        words = self.docs.select(F.explode(F.array_distinct(F.transform(_found(self.text, TERM), F.lower))).alias("term"))
        # counted in the tasks before they meet ``rare`` (a row for each term): a frequent word is one row of a task
        counts = words.groupBy("term").agg(F.count("*").alias("n_t")).join(self._few(rare), "term")
        counts = shelf.put(counts.where(F.col("n_t") <= most(F.lit(largest))), "counts")
        told = shelf.put(told.join(self._few(counts), "term"), "told_rare")

        both = told.join(holds.drop("copies"), "th").where(F.col("n_t") <= most(F.col("n_e")))
        pairs = both.groupBy("entity", "term", "n_e", "n_t").agg(F.sum("copies").alias("n_te"), F.count("*").alias("texts"), F.max("tied").alias("tied"))
        pairs = shelf.put(pairs.where("texts >= 2 or tied"), "pairs")
        judged = pairs.withColumn("pmi", F.log(F.col("n_te") * F.lit(float(n)) / F.col("n_t") / F.col("n_e"))).withColumn("ic", F.log(F.lit(float(n)) / F.col("n_e")))
        judged = judged.withColumn("strength", F.when(F.col("ic") > 0, F.col("pmi") / F.col("ic")).otherwise(0.0))
        judged = judged.where((F.col("strength") >= kept) & (F.col("tied") | ((F.col("texts") >= 2) & (F.col("texts") * F.col("pmi") >= self.evidence))))
        everywhere = (F.col("texts") >= 2) & (F.col("texts") * F.col("pmi") >= self.evidence) & (2 * F.col("n_te") > F.col("n_t"))
        judged = shelf.put(judged.select("entity", "term", "strength", everywhere.alias("everywhere")), "judged")

        removed = (F.max("strength") >= self.remove_at).alias("removed")
        inside = both.select("th", "entity", "term").join(self._few(judged), ["entity", "term"]).groupBy("th", "term").agg(removed)
        general = shelf.put(judged.where("everywhere").groupBy("term").agg(removed), "general")
        of_text = lambda hits: hits.groupBy("th").agg(F.collect_set(F.struct("term", "removed")).alias("hits"))
        elsewhere = None
        if not general.isEmpty():
            met = self.docs.select(F.md5(self.text).alias("th"), F.explode(F.array_distinct(F.transform(_found(self.text, TERM), F.lower))).alias("term")).join(self._few(general), "term")
            met = shelf.put(met.select("th", "term", "removed").distinct(), "met")
            inside = inside.unionByName(met.join(self._few(texts.select("th")), "th", "left_semi")).groupBy("th", "term").agg(F.max("removed").alias("removed"))
            others = shelf.put(of_text(met.join(self._few(texts.select("th")), "th", "left_anti")), "others")
            found = self.docs.select(F.md5(self.text).alias("th"), self.text.alias("text")).join(self._few(others), "th").dropDuplicates(["th"])
            found = found.withColumn("t", _found(F.col("text"), TERM)).withColumn("tg", F.split("text", TERM, -1))
            elsewhere = found.select("th", _extra(_terms(_matches(F.col("t"), F.col("tg")), F.array().cast(_NONE))).alias("extra"))
        hits = shelf.put(of_text(inside), "hits")
        added = texts.select("th", "terms").join(hits, "th").select("th", _extra(F.col("terms")).alias("extra"))
        self.elsewhere = shelf.put(elsewhere if elsewhere is not None else added.limit(0), "elsewhere")
        self.added = shelf.put(added.unionByName(self.elsewhere), "added")
        shelf.drop("told", "told_rare", "rare", "counts", "judged", "general", "met", "others", "hits", "texts", "holds", "entities")

    def spans(self) -> DataFrame:
        """``id``, ``th``, and ``spans``: all of them by start, then kind; a row per input row."""
        base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(False).alias("removed")))
        both = F.sort_array(F.concat(base.cast(_EXTRA), F.coalesce(F.col("extra"), F.array().cast(_EXTRA))))
        return self.base.join(self.added, "th", "left").select("id", "th", both.alias("spans"))

    def sanitised(self) -> DataFrame:
        """The input rows with the spans' text replaced; overlapping spans become one.

        Texts without a sign of a base span meet only the spans of ``elsewhere``, so few texts are shuffled.
        """
        docs, text = self.docs, F.col(self.text_col)
        th, found = fresh(docs, "_th"), fresh(docs, "_spans")
        table = lambda spans: spans.where(F.size("spans") > 0).select(F.col("th").alias(th), F.col("spans").alias(found))
        label = lambda s: F.when(s["kind"] == 4, F.when(s["removed"], F.lit("")).otherwise(F.lit("[TERM]"))).otherwise(F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]")))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        step = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), label(s))).otherwise(a["out"]).alias("out"))
        done = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
        new = F.when(F.col(found).isNull(), text).otherwise(F.aggregate(found, start, step, done))

        def replaced(rows: DataFrame, spans: DataFrame) -> DataFrame:
            joined = rows.withColumn(th, F.md5(self.text)).join(spans, th, "left")
            return joined.select(*(new.alias(c) if c == self.text_col else F.col(f"`{c}`") for c in docs.columns))

        signs = F.coalesce(F.rlike(text, F.lit(_SIGNS)), F.lit(False))
        plain = docs.where(~signs)
        if not self.elsewhere.isEmpty():
            plain = replaced(plain, self._few(table(self.elsewhere.withColumnRenamed("extra", "spans"))))
        return plain.unionByName(replaced(docs.where(signs), table(self.spans()).dropDuplicates([th])))


def _extra(terms: Column) -> Column:
    """The spans of a text's terms that are among its ``hits``."""
    span = lambda t, h: F.when(h.isNotNull(), F.struct(t["start"].alias("start"), F.lit(4).alias("kind"), t["end"].alias("end"), h.alias("removed")))
    of = lambda hits: F.transform(terms, lambda t: span(t, F.try_element_at(hits, t["term"])))
    spans = let(F.map_from_entries("hits"), of)
    return F.filter(spans, lambda s: s.isNotNull()).cast(_EXTRA)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = Sanitiser(table(spark, sf_dir, "documents")).spans()
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        F.col("id").alias("doc_id"),
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])),
        F.sha2(written(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        count(4).alias("n_term"),
    )
