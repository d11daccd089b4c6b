"""Personal data: candidate spans, boosted trees, calibrated thresholds. Only DataFrame functions.

Four base patterns and a few broader ones propose spans, which may overlap. A
base pattern's span is kept if it passes its kind's check. The others' spans
are scored by gradient-boosted stumps on their format and surroundings; the
boosting's sums are aggregates over a small labelled table. A candidate is kept
when its score reaches its kind's threshold, the lowest one that keeps the
precision on labelled rows that were not fitted, and it overlaps no base span.

A text is cut at the matches of a pattern; places follow from the lengths of
what lies between, summed over the matches of one text at a time. The text
itself is never shuffled to find spans.

The patterns take possessive repeats, and may begin only where a run of their
first characters does (or the last match ended): both leave the matches as
they are and keep the search linear on long runs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfare.llm.stored import stored

KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Generator:
    """A pattern that proposes spans of a kind, where the text holds one of ``needs`` at all."""

    name: str
    kind: str
    pattern: str
    needs: tuple[str, ...] = ()
    base: bool = False


GENERATORS = (
    Generator(
        "email", "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",), True,
    ),
    Generator("ip", "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", (".",), True),
    Generator("card", "card", r"[0-9](?:[\x20-]?[0-9])++", (), True),
    Generator("phone", "phone", r"\+[0-9][\x20().0-9-]+[0-9]", ("+",), True),
    Generator(
        "spelled_email", "email",
        r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[({<]\x20?at\x20?[\])}>]\x20?|\x20at\x20|\x20?@\x20?)[A-Za-z0-9-]++"
        r"(?:(?:\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++",
        ("(at", "[at", "{at", "<at", " at ", "@"),
    ),
    Generator(
        "grouped_phone", "phone",
        r"(?<![0-9A-Za-z+])(?:\(?[0-9]{2,4}\)?[\x20.-]\x20?){2,4}[0-9]{3,5}(?![0-9A-Za-z])",
    ),
    Generator("long_ip", "ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", (":",)),
    Generator(
        "any_phone", "phone",
        r"(?<![0-9A-Za-z+])\+?\(?[0-9](?:[\x20\u00a0().\-/]{0,3}[0-9]){6,14}(?![0-9A-Za-z])",
    ),
    Generator(
        "short_ip", "ip",
        r"(?<![0-9A-Za-z:_.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+)?"
        r"|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+)(?![0-9A-Za-z:_])",
        ("::",),
    ),
    Generator(
        "wide_card", "card",
        r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20\u00a0._/-]{1,3}[0-9]{2,7}){2,4}(?![0-9A-Za-z])",
    ),
)

KEYWORDS = (
    r"(?i)(?:mail|write|contact|reach|phone|tel|call|mobile|fax|dial|whatsapp|address|host|server|ip)\W*(?:\w+\W+)?$"
)
PHONE_WORDS = (
    r"(?iu)\b(?:tel|tél|telefon\w*|teléfono|téléphone|phone|call|mobile?|mobil|móvil|portable|cell|fax|dial|whatsapp|handy|"
    r"appelez|llame|llama|rufen|anruf\w*|reach|text|sms|contact|ring)\b\W*(?:\w+\W+){0,2}$"
)
OTHER_WORDS = (
    r"(?iu)\b(?:order|invoice|id|isbn|issn|version|rows?|pages?|lot|serial|part|table|dated?|ratio|items?|years?|since|time|"
    r"ref|count|steps?|room|number|code|sold|between|from|on|in|until|population|zip|timestamp|ticket|account)\b\W*$"
)
DATES = (
    r"^(?:1[5-9]|20)[0-9]{2}[\x20./-](?:(?:0?[1-9]|1[0-2])[\x20./-][0-9]{1,2}\b|(?:1[5-9]|20)[0-9]{2}\b)|"
    r"^[0-9]{1,2}[./-][0-9]{1,2}[./-](?:1[5-9]|20)[0-9]{2}$"
)
CONTEXT = 24

FEATURES = (
    "is_email", "is_phone", "is_ip", "length", "digits", "marks", "spaces", "area", "longest_run", "runs",
    "last_run", "bracket_at", "keyword", "touches", "is_card", "sum_right", "colons", "squeezed", "date", "national",
    "area_code", "phone_word", "other_word", "spelled_dot", "top_domain", "dotted_name", "upright",
    "global", "issuer",
)

ROUNDS = 12
RATE = 0.5
PRECISION = 0.95

# The labelled tables: texts whose candidates all are personal data, and texts whose candidates all are not. The trees
# are fitted to the first ones, the thresholds are set on the HELD ones. Of a card's text, the card is what is labelled.
PERSONAL = (
    "call me on (212) 555-0187 today", "phone 212-555-0199 after six", "tel. (030) 555-4471", "mobile 415.555.0142",
    "my number is (646) 555-0110", "reach us at (800) 555-3535 or later", "fax: 303-555-0166", "dial 617 555 0123 now",
    "(503) 555-0188", "contact (720) 555-0101, evenings", "whatsapp 702-555-0177", "call 213-555-0147",
    "mail john.doe [at] example [dot] org", "write to jane(at)mail.example(dot)com", "ann.lee [at] example.net",
    "bob_k(at)example.org", "contact m.ross [at] mail.example.com please", "tim (at) example (dot) net",
    "server 2001:db8:0:0:8:800:200c:417a", "address fe80:0:0:0:204:61ff:fe9d:f156", "host 2001:db8:85a3:8d3:1319:8a2e:370:7348",
    "ip 2001:db8:1:2:3:4:5:6",
    "phone 2125550187", "call 6465550132 now", "tel. 04915123456", "mobile: 01712345678", "dial 3035550144 today",
    "call (212)555-0187", "(303)555-0144 is mine", "my cell: (415)555-0101", "030/4471234", "tel. 089/1234567", "fax 0221/445566",
    "0171 2345678", "handy 0151 23456789", "ruf 0160 9988776 an", "01 23 45 67 89", "tél. 06.12.34.56.78", "portable 07 98 76 54 32",
    "call 555-0187", "phone 555 0123", "tel 555.0199", "teléfono 91 123 45 67", "móvil 612 345 678", "llame al 934 123 456",
    "05-61-22-33-44", "(0)30 4471 2345", "call 1-800-555-0199", "phone 1 212 555 0187", "+49 30/4471234", "tel 0049 30 4471234",
    "host 2001:db8::1", "fe80::204:61ff:fe9d:f156", "server ::ffff:c000:280", "2001:db8:85a3::8a2e:370:7334 is up", "fe80::1", "2a00:1450:4001::200e",
    "JOHN.DOE AT EXAMPLE DOT COM", "ann(AT)mail.example.org", "max{at}example.de", "lea [At] example [Dot] fr", "bob.k at mail dot example dot net",
    "joe@example[dot]com", "eve @ example.org", "tom <at> example <dot> es", "mail ana_b (at) example.es", "PAT [AT] EXAMPLE.NET",
    "john.smith at example.com", "contact ann_lee at mail.example.org",
)
OTHER = (
    "we met at noon.Then it rained", "look at page.html", "was at the.end", "here at home.x", "sold at 3.50 each",
    "starts at 10.30 sharp", "rows 10 20 30 4000", "pages 12 14 16 180", "in 1998 1999 2000", "2020 11 12 300",
    "version 10.20.30.400", "steps 11-22-33-444", "1994 1995 1996 1997", "lot 22 33 444 5555", "ratio 12:30:45:10",
    "at 10:20:30:40", "a:b:c:d", "time 01:02:03:04", "serial 1234 5678 90123", "part 99-88-77-66666", "isbn 978 30 16 148410",
    "id 20240131 0042", "12345678901234", "count 1 000 000", "+1 22", "+999 12", "scored 10-12, 11-13", "order 4444-55-666",
    "300.300.300.300", "1.2.3.999", "room 12 34 567", "table 10 12 14 1600", "order 22.33.44.5555",
    "2024-01-31", "on 31.12.2019", "12/31/2020", "between 1998-1999", "on 2021-03-04 10", "since 01.02.2003 we", "1914-1918", "in 2019/2020",
    "timestamp 1706659200", "id 2125550187", "order 5550187", "number 20240131", "population 8336817", "invoice 000123456", "3141592653", "1234567",
    "ref 100200300400", "isbn 9783161484100", "1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "2 4 6 8 10 12 14 16", "10 20 30 40 50 60 70", "sums 1000 2000 3000 4000",
    "zip 12345-6789", "1.000.000.000", "12.345.678", "sold 1.234.567 of it", "values 0.123 0.456 0.789", "7.25 8.50 9.75", "scores 100 200 300",
    "ticket 445-6677", "code 123-4567", "account 12-3456-78", "version 10.0.19041", "20 000 000 people",
    "use a::b in it", "call f::1", "b::c", "at ::a", "cafe::bed", "d::e",
    "we met at the cafe.Then", "LOOK AT PAGE.HTML", "sold it at amazon.com", "look at example.com", "read more at news.example.org",
    "shop at example.de", "was at home.Now", "aimed at users.We", "tweet @ noon.then", "look at index.php",
    "1234.5678.9012.3456", "4111.1111.1111.1112", "1111 - 2222 - 3333 - 4444", "1983.1984.1985.1986", "1989 / 1990 / 1991 / 1992", "1990 / 1991 / 1992 / 1993",
    "1000  2000  3000  4000", "4012/8888/8888/1882",
)
CARDS = (
    "card 4111.1111.1111.1111", "4111 - 1111 - 1111 - 1111", "visa 4012/8888/8888/1881", "5555_5555_5555_4444", "5105.1051.0510.5100", "3782.822463.10005",
    "4012  8888  8888  1881", "3566.0020.2036.0505",
)
HELD_PERSONAL = (
    "call (917) 555-0143 please", "phone 310-555-0122", "dial 206.555.0177", "tel. 7185550166", "reach me: 5125550108", "(646)555-0133",
    "040/5566778", "fax 0711/889900", "0176 8765432", "handy 0152 34567890", "02 34 56 78 90", "tél. 01.98.76.54.32", "03-44-55-66-77",
    "call 555-0111", "phone 555 0190", "móvil 655 443 322", "teléfono 93 765 43 21", "call 1-888-555-0123", "mobile 01629876543", "tel 0043 1 5566778",
    "2001:db8::42", "fe80::a00:27ff:fe4e:66a1", "address 2001:db8:0:1::17", "2a02:8109::3:4", "server 2001:db8:9:8:7:6:5:4", "host fe80::2",
    "SUE.LEE AT EXAMPLE DOT ORG", "kim(AT)example.com", "ole{at}example.net", "ida [at] example [dot] de", "r.roe at mail dot example dot com",
    "zoe@example[dot]fr", "mia (at) example (dot) org", "UWE [AT] MAIL.EXAMPLE.DE", "amy<at>example.com", "leo [At] example.es", "jim.doe at example.net",
)
HELD_CARDS = (
    "4242.4242.4242.4242", "5200 / 8282 / 8282 / 8210", "card 4000_0566_5566_5556", "visa 4242 - 4242 - 4242 - 4242", "6011.1111.1111.1117", "3530.1113.3330.0000",
)
HELD_OTHER = (
    "2023-11-05", "on 24.12.2018", "11/30/2021", "from 1939-1945", "until 03.10.1990 it", "1861-1865", "in 2011/2012", "timestamp 1650000000",
    "id 3035550144", "order 7654321", "number 19991231", "population 3769495", "2718281828", "7654321", "isbn 9780306406157", "ref 900800700600",
    "3 3 3 3 3 3 3 3 3 3 3 3", "5 10 15 20 25 30 35", "rows 100 200 300 400", "zip 90210-1234", "2.000.000.000", "98.765.432", "1.25 2.50 3.75 4.00",
    "ticket 998-7766", "code 765-4321", "version 12.1.20345", "35 000 000 items", "lot 11 222 3333 444", "table 12 15 18 2100", "part 77-66-55-44444",
    "see x::a in it", "c::d", "at ::f", "dead::beef", "time 04:05:06:07", "at 11:21:31:41",
    "they sat at the table.Later", "LOOK AT FILE.HTML", "seen at noon.After", "bought at shop.Then", "find us at example.net", "buy it at shop.example.fr", "look at main.php", "stayed at home.It",
    "9876.5432.1098.7654", "4242.4242.4242.4243", "2010.2011.2012.2013", "5555 - 6666 - 7777 - 8888", "2000 / 2001 / 2002 / 2003", "6011.1111.1111.1118",
)


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))


def _candidates(texts: DataFrame) -> DataFrame:
    """One row for each candidate of a text row, and one with NULLs for a text without any."""
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    none = F.array().cast("array<string>")
    for g in GENERATORS:
        found = F.regexp_extract_all("text", F.lit(g.pattern), F.lit(0))
        if g.needs:
            found = F.when(reduce(lambda a, b: a | b, [F.contains(F.lower("text") if x.isupper() or x.islower() else F.col("text"), F.lit(x)) for x in g.needs]), found).otherwise(none)
        rows = rows.withColumn(g.name, found)
    for g in GENERATORS:
        rows = rows.withColumn(f"{g.name}_gaps", F.when(F.size(g.name) > 0, F.split("text", g.pattern, -1)))

    def spans(g: Generator) -> Column:
        gaps = F.col(f"{g.name}_gaps")

        def span(match: Column, k: Column) -> Column:
            gap = F.get(gaps, k)
            return F.struct(
                F.lit(g.name).alias("generator"),
                F.lit(g.kind).alias("kind"),
                F.lit(g.base).alias("proposed"),
                k.alias("place"),
                F.length(gap).alias("gap"),
                F.length(match).alias("chars"),
                match.alias("match"),
                F.right(gap, F.lit(CONTEXT)).alias("before"),
                F.left(F.get(gaps, k + 1), F.lit(1)).alias("after"),
            )

        return F.transform(g.name, span)

    rows = rows.select("row", "doc_id", F.concat(*[spans(g) for g in GENERATORS]).alias("spans"))
    return rows.select("row", "doc_id", F.explode_outer("spans").alias("span")).select("row", "doc_id", "span.*")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is right."""
    turned = F.reverse(F.split(digits, ""))

    def value(d: Column, k: Column) -> Column:
        n = d.cast("int") * F.when(k % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(turned, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _checked(rows: DataFrame) -> DataFrame:
    """With ``base``: proposed by a base pattern and right by its kind's check."""
    rows = rows.withColumn("figures", F.regexp_replace("match", "[^0-9]", ""))
    n = F.length("figures")
    small = F.transform(F.split("match", r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    octets = F.forall(small, lambda x: (F.length(x) < 3) | (F.length(x) == 3) & (x <= "255"))
    card = F.when(n.between(14, 19), _luhn(F.col("figures"))).otherwise(False)
    right = F.when(F.col("kind") == "email", True).when(F.col("kind") == "ip", octets)
    right = right.when(F.col("kind") == "card", card).otherwise(n.between(10, 15))
    return rows.withColumn("base", F.coalesce(F.col("proposed") & right, F.lit(False)))


def _described(rows: DataFrame) -> DataFrame:
    """With a column for each of FEATURES."""
    runs = _runs(F.col("match"))
    longest = F.array_max(F.transform(runs, lambda x: F.length(x)))
    values = {
        **{f"is_{kind}": F.col("kind") == kind for kind in KINDS},
        "length": F.col("chars"),
        "digits": F.length("figures"),
        "marks": F.length(F.regexp_replace("match", "[0-9A-Za-z\\x20]", "")),
        "spaces": F.length(F.regexp_replace("match", "[^\\x20]", "")),
        "area": F.col("match").rlike(r"^\(?[0-9]{3}\)?[\x20.-]\x20?[0-9]{3}[\x20.-][0-9]{4}$"),
        "longest_run": longest,
        "runs": F.size(runs),
        "last_run": F.length(F.element_at(F.when(F.size(runs) > 0, runs), -1)),
        "bracket_at": F.col("match").rlike(r"(?i)[\[({<]\x20?at\x20?[\])}>]"),
        "keyword": F.col("before").rlike(KEYWORDS),
        "touches": F.col("after").rlike("[0-9A-Za-z]"),
        "sum_right": F.when(F.length("figures").between(13, 19), _luhn(F.col("figures"))).otherwise(False),
        "colons": F.length(F.regexp_replace("match", "[^:]", "")),
        "squeezed": F.contains("match", F.lit("::")) & F.col("match").rlike("[0-9]"),
        "date": F.col("match").rlike(DATES),
        "national": F.col("match").rlike(r"^\(?0") & F.length("figures").between(9, 14) & (F.size(runs) > 1) & ~F.contains("match", F.lit("  ")),
        "area_code": F.col("match").rlike(r"^(?:1[\x20.-])?\([0-9]{3}\)\x20?[0-9]{3}|^(?:1[\x20.-])[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"),
        "phone_word": (F.col("kind") == "phone") & F.col("before").rlike(PHONE_WORDS),
        "other_word": F.col("before").rlike(OTHER_WORDS),
        "spelled_dot": F.col("match").rlike(r"(?i)[\x20\[({<]dot[\x20\])}>]"),
        "top_domain": F.col("match").rlike(r"[\x20.\])}>](?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|be|ch|at|us|ca|mx|COM|ORG|NET|EDU|GOV|INFO|IO|DE|FR|ES|UK|EU|IT|NL|BE|CH|AT|US|CA|MX)$"),
        "dotted_name": F.col("match").rlike(r"(?i)^[a-z0-9%+-]+[._][a-z0-9._%+-]*\x20"),
        "global": F.col("match").rlike(r"(?i)^(?:[23][0-9a-f]{3}|f[cde][0-9a-f]{2}|:(?=:ffff:[0-9a-f]+:))[:]"),
        "issuer": F.col("match").rlike(r"^(?:4|5[0-8]|3[04-689]|6|2[2-7])"),
        "upright": F.contains("match", F.lit("@")),
    }
    return rows.withColumns({name: F.coalesce(values[name].cast("double"), F.lit(0.0)) for name in FEATURES})


Stump = tuple[str, float, float, float]  # feature, greatest value on the left, left and right leaf


def _margin(stumps: dict[str, list[Stump]]) -> Column:
    """The sum of its kind's leaves."""

    def total(own: list[Stump]) -> Column:
        leaves = [F.when(F.col(name) <= cut, a).otherwise(b) for name, cut, a, b in own]
        return reduce(lambda a, b: a + b, leaves, F.lit(0.0))

    return reduce(lambda a, kind: F.when(F.col("kind") == kind, total(stumps[kind])).otherwise(a), stumps, F.lit(0.0))


def labelled(spark: SparkSession) -> DataFrame:
    """Candidates of the labelled tables, described, with their label ``y`` and whether they are ``held`` from the fit."""
    tables = ((PERSONAL, 1), (OTHER, 0), (CARDS, 5), (HELD_PERSONAL, 3), (HELD_OTHER, 2), (HELD_CARDS, 7))
    values = ", ".join(f"({k}, '{text}')" for texts, k in tables for text in texts)
    texts = spark.sql(f"SELECT k AS doc_id, text FROM VALUES {values} AS t(k, text)").coalesce(1)
    rows = _described(_checked(_candidates(texts).where("kind IS NOT NULL"))).where("NOT proposed")
    rows = rows.where("doc_id % 2 = 0 OR (doc_id > 4) = (kind = 'card')")
    y, held = (F.col("doc_id") % 2).cast("double"), F.col("doc_id").isin(2, 3, 7)
    return rows.select(y.alias("y"), held.alias("held"), "kind", *FEATURES)


def boost(examples: DataFrame, rounds: int = ROUNDS) -> dict[str, list[Stump]]:
    """Of each kind, stumps by Newton boosting of the logistic loss; the examples are few and stay in one task."""
    stumps: dict[str, list[Stump]] = {}
    pairs = ", ".join(f"'{name}', {name}" for name in FEATURES)
    whole = Window.partitionBy("kind", "feature")
    up_to = whole.orderBy("value")
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-_margin(stumps)))
        rows = examples.coalesce(1).select("kind", (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"), *FEATURES)
        rows = rows.select("kind", "g", "h", F.expr(f"stack({len(FEATURES)}, {pairs}) AS (feature, value)"))
        sums = rows.groupBy("kind", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        cuts = sums.select(
            "kind",
            "feature",
            "value",
            F.sum("g").over(up_to).alias("gl"),
            F.sum("h").over(up_to).alias("hl"),
            F.sum("g").over(whole).alias("g"),
            F.sum("h").over(whole).alias("h"),
        )
        left, right = F.col("gl") / (F.col("hl") + 1), (F.col("g") - F.col("gl")) / (F.col("h") - F.col("hl") + 1)
        cuts = cuts.withColumns({"left": left, "right": right})
        cuts = cuts.withColumn("gain", F.col("left") * F.col("gl") + F.col("right") * (F.col("g") - F.col("gl")))
        best = cuts.groupBy("kind").agg(F.max(F.struct("gain", "feature", "value", "left", "right")).alias("best"))
        for row in best.orderBy("kind").collect():
            x = row["best"]
            stumps.setdefault(row["kind"], []).append((x["feature"], x["value"], RATE * x["left"], RATE * x["right"]))
    return stumps


def thresholds(examples: DataFrame, stumps: dict[str, list[Stump]]) -> dict[str, float]:
    """Of each kind, the lowest score from which on the labelled candidates are personal often enough."""
    rows = examples.coalesce(1).select("kind", "y", _margin(stumps).alias("score"))
    from_ = Window.partitionBy("kind").orderBy(F.desc("score"))
    rows = rows.withColumn("precise", F.avg("y").over(from_))
    kept = rows.where((F.col("precise") >= PRECISION) & (F.col("y") == 1)).groupBy("kind").agg(F.min("score").alias("score"))
    return {row["kind"]: row["score"] for row in kept.collect()}


def find_personal_data(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document row: row, doc_id, spans.

    ``spans`` is an array of (start, kind_no, end, kind, base) in order of
    start, then of KINDS: code points from 0, the end exclusive. NULL and empty
    texts have none. Repeated rows and NULL ids stay, each with spans of its
    own; ``row`` numbers the rows. An empty table gives an empty table; other
    columns are not read.
    """
    spark = documents.sparkSession
    examples = stored(labelled(spark), "pii-examples")
    stumps = boost(examples.where("NOT held"))
    least = thresholds(examples.where("held"), stumps)
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = _candidates(texts).repartition("row")

    so_far = Window.partitionBy("row", "generator").orderBy("place")
    earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum("gap").over(so_far) + F.coalesce(F.sum("chars").over(earlier), F.lit(0))
    rows = _described(_checked(rows.withColumn("start", start))).withColumn("end", F.col("start") + F.col("chars"))
    cut = reduce(lambda a, kind: F.when(F.col("kind") == kind, least[kind]).otherwise(a), least, F.lit(None).cast("double"))
    rows = rows.withColumn("chosen", F.coalesce(~F.col("proposed") & (_margin(stumps) >= cut), F.lit(False)))

    # a candidate gives way to base spans that end after its start, and begin before its end
    ordered = Window.partitionBy("row").orderBy("start")
    reached = F.max(F.when(F.col("base"), F.col("end"))).over(ordered.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(ordered.rangeBetween(0, Window.unboundedFollowing))
    free = F.coalesce(reached <= F.col("start"), F.lit(True)) & F.coalesce(ahead >= F.col("end"), F.lit(True))
    rows = rows.withColumn("kept", F.coalesce(F.col("base") | F.col("chosen") & free, F.lit(False)))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct("start", number.alias("kind_no"), "end", "kind", "base")
    spans = F.array_sort(F.collect_set(F.when(F.col("kept"), span)))
    return rows.groupBy("row", "doc_id").agg(spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    one = lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with ``[KIND]`` in place of personal data in their texts.

    Spans that overlap become one, named by the first. All columns stay, NULL
    texts too. Rows that share id and text share their spans.
    """
    others = F.struct(*[F.col(name) for name in documents.columns if name != text])
    rows = documents.select(others.alias("others"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = rows.withColumn("key", F.struct("id", F.xxhash64("text").alias("text")))
    found = find_personal_data(rows, doc_id="key").where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias("key"), F.explode("spans").alias("span")).select("key", "span.*").distinct()

    # overlapping spans become one
    ordered = Window.partitionBy("key").orderBy("start", "kind_no", "end")
    reached = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("new", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
    apart = apart.withColumn("group", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by("kind", F.struct("start", "kind_no"))
    cut = apart.groupBy("key", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), first.alias("kind"))
    ends = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "kind")
    cuts = cut.groupBy("key").agg(F.array_sort(F.collect_list(ends)).alias("cuts"))
    cuts = cuts.select(F.col("key.id").alias("cut_id"), F.col("key.text").alias("cut_text"), "cuts").hint("shuffle_hash")
    same = F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("key.text") == F.col("cut_text"))
    joined = rows.join(cuts, same, "left")

    def kept(cut: Column, k: Column) -> Column:
        last = F.when(k == 0, 0).otherwise(F.get("cuts", k - 1)["end"])
        return F.concat(F.substring("text", last + 1, cut["start"] - last), F.lit("["), F.upper(cut["kind"]), F.lit("]"))

    tail = F.substring("text", F.element_at("cuts", -1)["end"] + 1, F.length("text"))
    whole = F.concat(F.array_join(F.transform("cuts", kept), ""), tail)
    redacted = F.when(F.col("cuts").isNotNull(), whole).otherwise(F.col("text")).alias(text)
    return joined.select(*[redacted if name == text else F.col("others")[name].alias(name) for name in documents.columns])
