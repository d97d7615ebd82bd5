"""Secret scans with multipart credential linking. DataFrame functions only.

Strong spans (an assigned secret of eight characters, an access identifier, a long hex string) are reported as they
stand. A weak candidate, such as a user name, a short password or a host, is reported only where the parts that complete
a credential stand near it: an interval join of the parts of one text. Only whether a partner exists matters, so the
join sorts a text's parts once and looks at the nearest on either side instead of making pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import stored, text_key

_SIGN = r"""["']?\x20*[:=]\x20*["']?"""
#: Patterns of the strong kinds; a match that fails its least length may still be a weak candidate.
ASSIGN = rf"((?i:password|passwd|secret|token|api_?key)){_SIGN}([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Patterns of weak candidates by the part of a credential that they are.
IDENTIFIER = rf"(?i:user(?:_?name)?|login|account|client_?id|key_?id){_SIGN}[A-Za-z0-9@+/_.=-]+|ASIA[A-Z0-9]{{12,}}"
LABELLED = rf"(?i:pass(?:phrase)?|pwd|credential|private_?key|auth){_SIGN}[A-Za-z0-9+/_.=-]{{4,}}"
UNLABELLED = r"[A-Za-z0-9+/]{40,}={0,2}"
ENDPOINT = rf"[A-Za-z][A-Za-z0-9+.-]{{1,15}}://[^\x20\x09-\x0D\"'<>]+|(?i:host(?:_?name)?|server|endpoint|database){_SIGN}[A-Za-z0-9.:/_-]+"
#: Parts are linked within a scope only; a blank line ends one.
BREAK = r"\n[\x20\x09\x0B-\x0D]*\n"
WEAK = (("identifier", IDENTIFIER), ("labelled", LABELLED), ("unlabelled", UNLABELLED), ("endpoint", ENDPOINT), ("break", BREAK))
#: Kinds of spans in the order of their listing.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: Characters between parts that complete one another, at most.
REACH = 300


PARTS = "array<struct<pattern: int, part: string, strong: boolean, gap: bigint, size: bigint>>"


def _matches(text: Column, number: int, pattern: str, part: str | Column, strong: Column | None = None) -> Column:
    """Pattern number, part, strong, characters since the match before, characters of each leftmost match in turn."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))

    def one(gap: Column, x: Column) -> Column:
        name = part(x) if callable(part) else F.lit(part)
        sure = strong(x) if strong else F.lit(False)
        return F.struct(F.lit(number).alias("pattern"), name.alias("part"), sure.alias("strong"), F.length(gap).cast("long").alias("gap"), F.length(x).cast("long").alias("size"))

    return F.zip_with(gaps, found, one)


def parts_of(text: Column) -> Column:
    """All matches of a text that is not null; weak parts only where an identifier may stand."""
    none = F.array().cast(PARTS)

    def least(kind: str, x: Column) -> Column:
        return F.length(x) >= LEAST[kind]

    def mixed(x: Column) -> Column:
        """A short hex string counts with letters and figures only; a plain number is no secret."""
        return F.when(least("hex", x) | (x.rlike("[a-f]") & x.rlike("[0-9]")), "hex").otherwise("none")

    base = [
        F.when(text.rlike(ASSIGN), _matches(text, 0, ASSIGN, "assign", lambda x: least("assign", F.regexp_extract(x, ASSIGN, 2)))).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), _matches(text, 1, ACCESS, "access", lambda x: least("access", x))).otherwise(none),
        F.when(text.rlike(HEX), _matches(text, 2, HEX, mixed, lambda x: least("hex", x))).otherwise(none),
    ]
    weak = [_matches(text, 3 + k, pattern, part) for k, (part, pattern) in enumerate(WEAK)]
    return F.concat(*base, F.when(text.rlike(IDENTIFIER) | F.contains(text, F.lit("AKIA")), F.concat(*weak)).otherwise(none))


def link(parts: DataFrame, key: list[str], reach: int = REACH) -> DataFrame:
    """(key, kind, start, end) of the reported spans among parts (key, part, strong, start, end) of the keys' texts.

    Weak parts inside or across a strong one are not parts of their own, nor is an unlabelled secret across an
    identifier. An identifier needs a secret within ``reach`` characters and no break between, a secret an identifier,
    an endpoint both. Strong parts complete weak ones and need nothing themselves.
    """
    ordered = Window.partitionBy(*key).orderBy("start", "end", "part").rowsBetween(Window.unboundedPreceding, -1)
    turned = Window.partitionBy(*key).orderBy(F.desc("start"), F.desc("end"), F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)

    def before(which: Column) -> Column:
        return F.max(F.when(which, F.col("end"))).over(ordered)

    def after(which: Column) -> Column:
        return F.min(F.when(which, F.col("start"))).over(turned)

    strong, weak_identifier = F.col("strong"), (F.col("part") == "identifier")
    marked = parts.select("*", before(strong).alias("_sb"), before(weak_identifier).alias("_ib"), after(strong).alias("_sa"), after(weak_identifier).alias("_ia"))

    def across(low: str, high: str) -> Column:
        return F.coalesce(F.col(low) > F.col("start"), F.lit(False)) | F.coalesce(F.col(high) < F.col("end"), F.lit(False))

    lost = ~strong & (F.col("part") != "break") & (across("_sb", "_sa") | ((F.col("part") == "unlabelled") & across("_ib", "_ia")))
    kept = marked.where(~lost).drop("_sb", "_sa", "_ib", "_ia")
    identifier, secret, pause = F.col("part").isin("access", "identifier"), F.col("part").isin("assign", "hex", "labelled", "unlabelled"), F.col("part") == "break"
    seen = kept.select("*", *[f(which).alias(f"_{name}{side}") for name, which in (("i", identifier), ("s", secret), ("b", pause)) for side, f in (("b", before), ("a", after))])

    def near(name: str) -> Column:
        back, ahead = F.col(f"_{name}b"), F.col(f"_{name}a")
        left = (back >= F.col("start") - reach) & (back > F.coalesce("_bb", F.lit(-1)))
        right = (ahead <= F.col("end") + reach) & (F.col("_ba").isNull() | (ahead < F.col("_ba")))
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    told = F.when(strong, True).when(pause, False).when(identifier, near("s")).when(secret, near("i")).otherwise(near("i") & near("s"))
    kind = F.when(strong | F.col("part").isin("identifier", "endpoint"), F.col("part")).when(F.col("part") == "access", "identifier").otherwise("secret")
    return seen.where(told).select(*key, kind.alias("kind"), "start", "end")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """Per row: doc_id and ``found``, the spans (start, rank, end, kind) of its text, by start, then kind as in ``KINDS``.

    Spans are in code points, the end exclusive. Matches of a kind do not overlap; those of different kinds may. Null
    and empty texts have none. Repeated rows come back as often as given; other columns are not read. Parts are linked
    once per different text; what crosses the network is some bytes per match. A task holds the matches of a text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), *text_key(F.col(text)), parts_of(whole).alias("parts"))
    rows = stored(rows.withColumn("parts", F.when(F.size("parts") > 0, F.col("parts"))), "secrets-parts")
    key = ["_t1", "_t2"]
    texts = rows.where("parts is not null").groupBy(*key).agg(F.first("parts").alias("parts"))
    each = texts.select(*key, F.posexplode("parts").alias("_k", "_x")).select(*key, "_k", "_x.*")
    so_far = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy(*key, "pattern").orderBy("_k"))
    placed = each.select(*key, "part", "strong", (so_far - F.col("size")).alias("start"), so_far.alias("end")).where("part <> 'none'")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    spans = link(placed, key, reach).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("found"))  # of one text
    spans = stored(spans, "secrets-spans")
    none = F.array().cast(spans.schema["found"].dataType)
    joined = rows.where("parts is not null").join(spans, key, "left").select("doc_id", F.coalesce("found", none).alias("found"))
    return rows.where("parts is null").select("doc_id", none.alias("found")).unionByName(joined)


def listed(found: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat(x["kind"], F.lit(":"), x["start"], F.lit(":"), x["end"])), ",")
