"""Personal data: high-recall generators propose spans, boosted trees judge them, calibrated thresholds select redactions."""

from __future__ import annotations

import json
import math
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import filled, let, scan

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A run of characters in which no match can start later than at its first character is entered there
#: only, or where the last match ended, and repeated groups are possessive: matches are the same, time and stack linear.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": "[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT = r"(?i:@| ?\[at\] ?| ?\(at\) ?| at )"
_DOT = r"(?i:\.| ?\[dot\] ?| ?\(dot\) ?| dot )"
#: Generators of candidates: addresses however spelled, digits with up to two signs between, digits without blanks, octets.
#: A match of one in PARTS is a run of digit groups (and a letter or digit that touches its end), of which parts are proposed.
GENERATORS = (
    rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Za-z+(])[+(]{0,2}[0-9](?:[ ()./-]{0,2}[0-9]){6,}+[A-Za-z]?",
    r"(?<![0-9A-Za-z./-])[0-9](?:[./-]?[0-9]){6,}+(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3,}+[0-9A-Za-z]?",
)
_GROUP = r"[+(]{0,2}[0-9]++(?![A-Za-z])"
#: Most digit groups of a part, and what a part is like.
PARTS = {1: (19, r"^(?:[^0-9]*[0-9]){7,19}$"), 3: (4, r"^[0-9]{1,3}(?:[^0-9]+[0-9]{1,3}){3}$")}
#: Words before a span that tell its kind, by context code 1 to 5.
CONTEXT = (r"(tel|phone|call|mobile|fax|cell|dial)", r"(e-?mail|contact|write|reach)", r"(card|visa|mastercard|amex|credit|account)", r"(\bip\b|addr|host|server|gateway)", r"(version|isbn|order|licen|no\.|serial|price|page|date|sku|item|part|model|built|invoice|ticket|case|build|stock|ref|batch|parcel|\$|€)")
NAMES = ("generator", "digits", "groups", "longest", "signs", "lead", "luhn", "octets", "context", "spelled", "first", "last", "shape", "before", "follows", "zero")
#: Lengths of digit groups that telephone and card numbers are often written in, or dates, by shape code 1 to 6.
SHAPES = (r"^ ?3 3 4$", r"^\+[1-3] 3 3 4$", r"^ 4 (4 4 4|6 [45])$", r"^ 1[2-9]$", r"^ (4 2 2|2 2 4)( |$)", r"^ 3 4 4$")
CONTEXT_CHARS = 24
_SPAN = "array<struct<s:int,e:int,m:string,g:string,f:string>>"
_PART = "array<struct<s:int,e:int,m:string,ctx:string,f:string,before:int,after:int>>"


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    value = lambda c, i: F.when(i % 2 == 1, (2 * c.cast("int")) - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def spans(text: Column, pattern: str, guard: str) -> Column:
    """Leftmost non-overlapping matches as (s, e, m, g, f): start and end (exclusive) in code points, the match, and what stands
    before it, up to CONTEXT_CHARS back to the match before, and after it. Texts without a match of ``guard`` are not searched."""
    rows = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("n"), F.right(gap, F.lit(CONTEXT_CHARS)).alias("g"), F.left(gap, F.lit(1)).alias("f"), m.alias("m")))
    long = lambda x: x["n"] + F.coalesce(F.length(x["m"]), F.lit(0))

    def placed(r: Column) -> Column:
        one = lambda at: lambda x, i: F.struct((F.get(at, i) + x["n"]).alias("s"), (F.get(at, i) + long(x)).alias("e"), x["m"].alias("m"), x["g"].alias("g"), F.coalesce(F.get(r, i + 1)["f"], F.lit("")).alias("f"))
        return let(scan(F.transform(r, long), F.lit(0), lambda x, y: x + y), lambda at: F.filter(F.transform(r, one(at)), lambda x: x["m"].isNotNull()))

    return F.when(text.rlike(guard), let(rows, placed)).otherwise(F.array().cast(_SPAN))


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def base(text: Column) -> list[Column]:
    """A column for each kind: its valid base spans."""
    guard = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
    valid = lambda k: lambda x: _valid(k, x["m"])
    return [F.filter(spans(text, BASE[k], guard[k]), valid(k)).alias(k) for k in KINDS]


def parts(runs: Column, most: int, like: str) -> Column:
    """For each run of digit groups, itself without signs at its end, and what is ``like`` from any of its groups to any other,
    over ``most`` groups at most, as _PART; before and after tell whether groups of the run are left out there (before is 2
    where a country code is). As a group has a digit at least, the parts of a run are at most a constant times its groups,
    and each is put together from its groups alone."""

    def of(run: Column, groups: Column, pieces: Column) -> Column:
        n = F.size(groups)

        def part(a: Column, b: Column, i: Column, j: Column) -> Column:
            m = F.concat(a["m"], F.array_join(F.slice(pieces, i + 2, j - i), ""))
            ctx = F.right(F.concat(run["ctx"], F.array_join(F.slice(pieces, F.greatest(i - CONTEXT_CHARS, F.lit(0)) + 1, F.least(i, F.lit(CONTEXT_CHARS))), ""), a["g"]), F.lit(CONTEXT_CHARS))
            f = F.when(j < n - 1, F.left(F.get(pieces, j + 1), F.lit(1))).otherwise(F.when(b["e"] < F.length(run["m"]), F.right(run["m"], F.lit(1))).otherwise(run["f"]))
            before = F.when(i == 0, 0).when(F.get(groups, i - 1)["m"].startswith("+"), 2).otherwise(1)
            return F.struct((run["s"] + a["s"]).alias("s"), (run["s"] + b["e"]).alias("e"), m.alias("m"), ctx.alias("ctx"), f.alias("f"), before.alias("before"), (j < n - 1).cast("int").alias("after"))

        digits = lambda a, b: b["e"] - a["s"]  # noqa: E731  # at least as many characters as digits
        ends = lambda a, i: F.filter(F.transform(F.slice(groups, i + 1, most), lambda b, k: F.struct(b.alias("b"), (i + k).alias("j"))), lambda x: digits(a, x["b"]) <= 3 * 19)
        inner = F.flatten(F.transform(groups, lambda a, i: F.filter(F.transform(ends(a, i), lambda x: part(a, x["b"], i, x["j"])), lambda x: x["m"].rlike(like) & (x["before"] + x["after"] > 0))))
        whole = part(F.get(groups, F.lit(0)), F.get(groups, n - 1), F.lit(0), n - 1)
        return F.when(n > 0, F.concat(F.filter(F.array(whole), lambda x: F.length(F.regexp_replace(x["m"], "[^0-9]", "")) >= 7 if most > 4 else x["m"].rlike(like)), inner)).otherwise(F.array().cast(_PART))

    joined = lambda groups: F.transform(groups, lambda x: F.concat(x["g"], x["m"]))
    return F.flatten(F.transform(runs, lambda r: let(spans(r["m"], _GROUP, "[0-9]"), lambda g: let(joined(g), lambda p: of(r, g, p)))))


def candidates(text: Column) -> Column:
    """Candidates of all generators with their features, as an array of structs (s, e, m, NAMES and after as int); spans overlap."""
    guards = ("(?i)@|[\\[( ]at[\\]) ]", "[0-9]", "[0-9]", "[0-9][. \\[(]")

    def described(generator: int) -> Column:
        def one(x: Column) -> Column:
            numbers = F.regexp_extract_all(x["m"], F.lit("[0-9]+"), F.lit(0))
            return let(F.struct(F.array_join(numbers, "").alias("digits"), F.transform(numbers, lambda r: F.length(r)).alias("runs"), F.lower(x["ctx"]).alias("before")), lambda known: described_by(x, known))

        def described_by(x: Column, known: Column) -> Column:
            m, digits, runs, before = x["m"], known["digits"], known["runs"], known["before"]
            context = F.lit(0)
            for code in range(len(CONTEXT), 0, -1):
                context = F.when(before.rlike(CONTEXT[code - 1]), code).otherwise(context)
            signs = F.when(m.rlike("[()]"), 4).when(m.contains("/"), 5).when(m.contains("-"), 2).when(m.contains("."), 3).when(m.contains(" "), 1).otherwise(0)
            check = F.when(F.length(digits).between(12, 19), luhn(digits).cast("int")).otherwise(2)
            octets = m.rlike(r"^[0-9]{1,3}([^0-9]+[0-9]{1,3}){3}$") & F.forall(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda r: F.coalesce(r.try_cast("int"), F.lit(999)) <= 255)
            spelled = F.when(m.contains("@"), 1).when(m.rlike(r"(?i)\[at\]|\(at\)"), 2).when(m.rlike("(?i) at .*( dot |[\\[(]dot)"), 3).when(m.rlike("(?i) at "), 4).otherwise(0)
            lengths = F.concat(F.when(m.startswith("+"), "+").otherwise(" "), F.array_join(runs.cast("array<string>"), " "))
            shape = F.lit(0)
            for code, like in enumerate(SHAPES, 1):
                shape = F.when(lengths.rlike(like), code).otherwise(shape)
            follows = F.when(x["f"].isin(":", "%", "°"), 1).when(x["f"].rlike("[A-Za-z0-9]"), 2).otherwise(0)
            values = (F.lit(generator), F.least(F.length(digits), F.lit(24)), F.least(F.size(runs), F.lit(9)), F.coalesce(F.least(F.array_max(runs), F.lit(20)), F.lit(0)), signs, F.when(m.startswith("+"), 1).when(m.startswith("("), 2).otherwise(0), check, octets.cast("int"), context, spelled, *(F.coalesce(F.least(F.get(runs, at), F.lit(20)), F.lit(0)) for at in (F.lit(0), F.size(runs) - 1)), shape, x["before"], follows, digits.startswith("0").cast("int"))
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), m.alias("m"), *(v.cast("int").alias(n) for v, n in zip(values, NAMES, strict=True)), x["after"].alias("after"))

        found = spans(text, GENERATORS[generator], guards[generator])
        behind = lambda r, i: F.coalesce(F.concat(F.get(r, i - 1)["g"], F.get(r, i - 1)["m"]), F.lit(""))
        seen = let(found, lambda r: F.transform(r, lambda x, i: F.struct(x["s"], x["e"], x["m"], F.right(F.concat(behind(r, i), x["g"]), F.lit(CONTEXT_CHARS)).alias("ctx"), x["f"], F.lit(0), F.lit(0)).cast(_PART[6:-1])))
        return F.transform(parts(seen, *PARTS[generator]) if generator in PARTS else seen, one)

    return F.concat(*(described(g) for g in range(len(GENERATORS))))


#: Examples to learn from, as (kind or none, template). # is a digit, $ a digit that makes the span pass the
#: Luhn check, % a number up to 255, ~ a letter. ⟦⟧ enclose the item of the kind where others stand beside it.
TEMPLATES = (
    ("email", "write to ~~~~.##@~~~~.~~~ please"), ("email", "~~~~~@~~~~.~~.~~"), ("email", "contact ~~~~~ [at] ~~~~~ [dot] ~~~"), ("email", "~~~~~(at)~~~~~(dot)~~~"), ("email", "e-mail ~~~~ at ~~~~~ dot ~~~"), ("email", "~~~~~ at ~~~~ dot ~~~ now"), ("email", "mail ~~~~[at]~~~~.~~~"),
    ("none", "we met at home.then left"), ("none", "look at ~~~~.~~~~ again"), ("none", "sold at ~~~~~.~~ each"), ("none", "was at ~~~.~~~~~ there"),
    ("phone", "+1 (###) ###-#### now"), ("phone", "call (###) ###-#### today"), ("phone", "tel ###-###-####"), ("phone", "phone ### ### ####"), ("phone", "(###) ###-####"), ("phone", "+## ### ### ####"), ("phone", "mobile 0### ######"), ("phone", "fax: ###.###.####"), ("phone", "the ###-###-#### one"), ("phone", "+##-##-####-####"),
    ("none", "on ####-##-## it"), ("none", "date ##/##/####"), ("none", "isbn ###-#-##-######-#"), ("none", "order no. ########"), ("none", "version #.#.#.####"), ("none", "the ########## of"), ("none", "page ####-####"), ("none", "in ####-#### the"), ("none", "serial ####-####-##"), ("none", "#######"), ("none", "the ########### ones"), ("none", "price $ #######.##"), ("none", "was ############# and"),
    ("card", "card ###############$"), ("card", "visa #### #### #### ###$"), ("card", "####-####-####-###$"), ("card", "the ###############$ of"), ("card", "####.####.####.###$ by"), ("card", "credit card #### #### #### ####"), ("card", "#### ###### ####$"),
    ("none", "the ################ of"), ("none", "serial ################"), ("none", "####-####-####-####"), ("none", "####.####.####.####"), ("none", "order ##################"), ("none", "##############################"), ("none", "# # # # # # # # # # # # # # # # # # # # # # # #"), ("none", "the ##########################$ of"),
    ("ip", "at %.%.%.% then"), ("ip", "server %[.]%[.]%[.]% up"), ("ip", "host % . % . % . %"), ("ip", "ip %(.)%(.)%(.)%"), ("ip", "the %[.]%[.]%[.]% one"),
    ("none", "version #.#.#.#"), ("none", "page ###.###.###.###"), ("none", "scores # . # . # . # and"),
    ("phone", "## ⟦###-###-####⟧ ##"), ("phone", "## ⟦###-###-####⟧"), ("phone", "⟦###-###-####⟧ ##"), ("phone", "## ⟦(###) ###-####⟧"), ("phone", "⟦(###) ###-####⟧ ##"), ("phone", "⟦+1 (###) ###-####⟧ ##"), ("phone", "⟦### ### ####⟧ ### ### ####"), ("phone", "### ### #### ⟦### ### ####⟧"), ("phone", "#### ⟦(###) ###-####⟧ ##"), ("phone", "⟦(###) ###-####⟧ (###) ###-####"), ("phone", "⟦###-###-####⟧ #### #### #### ####"), ("phone", "#### #### #### #### ⟦###-###-####⟧"), ("phone", "%.%.%.% ⟦(###) ###-####⟧ %.%.%.%"), ("phone", "⟦+1 (###) ###-####⟧ %.%.%.%"), ("phone", "⟦+1 (###) ###-####⟧ #### #### #### ####"), ("phone", "⟦+## ### ### ####⟧ ##"), ("phone", "%.%.%.% ⟦###-###-####⟧"), ("phone", "⟦###.###.####⟧ ###.###.####"), ("phone", "⟦###-###-####⟧ %.%.%.%"), ("phone", "################ ⟦###-###-####⟧"),
    ("card", "## ⟦#### #### #### ###$⟧ ##"), ("card", "## ⟦#### #### #### ###$⟧"), ("card", "⟦#### #### #### ###$⟧ ##"), ("card", "## ⟦####-####-####-###$⟧"), ("card", "⟦####-####-####-###$⟧ ##"), ("card", "## ⟦###############$⟧"), ("card", "⟦###############$⟧ ##"), ("card", "⟦#### #### #### ###$⟧ #### #### #### ####"), ("card", "#### #### #### #### ⟦#### #### #### ###$⟧"), ("card", "### ### #### ⟦#### #### #### ###$⟧ ###-###-####"), ("card", "## ⟦####-####-####-###$⟧ ##"), ("card", "%.%.%.% ⟦####-####-####-###$⟧ %.%.%.%"), ("card", "## ⟦###############$⟧ ##"), ("card", "###-###-#### ⟦###############$⟧"), ("card", "## ⟦#### ###### ####$⟧ ##"), ("card", "## ⟦####.####.####.###$⟧ ##"),
    ("ip", "## ⟦% . % . % . %⟧ ##"), ("ip", "⟦%[.]%[.]%[.]%⟧ ###-###-####"), ("ip", "###-###-#### ⟦%[.]%[.]%[.]%⟧"),
    ("none", "#### #### ####"), ("none", "### ### ### ### ### ###"), ("none", "####-##-## ####-##-##"), ("none", "## ## ## ## ## ## ## ## ##"),
)
#: More of the same to learn from, dates, times and stock numbers among them.
TEMPLATES += (
    ("email", "mail me: ~~~~~ AT ~~~~~~ DOT ~~~"), ("email", "~~~~.~~~~~ [AT] ~~~~~ [DOT] ~~"), ("email", "(~~~~~ at ~~~~~~ dot ~~)"), ("email", "reach ~~~~## at ~~~~ dot ~~~"),
    ("none", "stay at ~~~~~~ for"), ("none", "we look AT ~~~~.~~~~ then"), ("none", "meet at ~~~~~.~~~~ said"), ("none", "arrive at ~~~~.~~ by"), ("none", "at ~~~~~. ~~~~~"),
    ("phone", "0## #### ####"), ("phone", "call 0## #### #### after"), ("phone", "0#### ######"), ("phone", "tel. 0##-####-####"), ("phone", "the 0### ### #### line"), ("phone", "(0##) #### ####"), ("phone", "+## ## #### ####"), ("phone", "+1-###-###-####"), ("phone", "ring ###.###.#### or"), ("phone", "phone (###)###-####"), ("phone", "+##(0)## #### ####"),
    ("card", "%[.]%[.]%[.]% ⟦#### #### #### ###$⟧"), ("card", "⟦#### #### #### ###$⟧ %[.]%[.]%[.]%"), ("card", "%.%.%.% ⟦###############$⟧"), ("card", "on ## ⟦#### #### #### ###$⟧ we"),
    ("none", "built ####-##-## ##:##:##"), ("none", "at ####-##-## ##:## the"), ("none", "on ##.##.#### at ##:##"), ("none", "from ##/##/#### to ##/##/####"), ("none", "the ####/##/## one"), ("none", "####.##.## and"), ("none", "log ####-##-## ##:##:##.### ok"), ("none", "date ##-##-####"), ("none", "####-##-## ##"), ("none", "####-##-## to ####-##-##"),
    ("none", "sku ###-###-####"), ("none", "item ###-###-####"), ("none", "part ###.###.####"), ("none", "model ###-####-###"), ("none", "stock ### ### ####"), ("none", "sku #### #### ####"), ("none", "invoice ##########"), ("none", "case ###-#######"), ("none", "ticket ########-##"), ("none", "ref 0## #### ####"), ("none", "batch ################"), ("none", "sku: ####-####-####-####"), ("none", "order ####-####-####-####"), ("none", "parcel #### #### #### ####"),
    ("none", "#######% of"), ("none", "# ### ### ### euros"), ("none", "about ## ### ###"), ("none", "##,### and ###,###,###"), ("none", "lat ##.###### lon"), ("none", "build #.##.###.####"), ("none", "model ##.##.##.##"), ("none", "ver. ###.##.#.#"),
)
#: Templates that thresholds are calibrated on. None of them, nor their wording, is among those learned from.
CALIBRATION = (
    ("email", "ask ~~~~~~ at ~~~~~~ dot ~~~ today"), ("email", "my address is ~~~~_~~ (at) ~~~~~ (dot) ~~~"), ("email", "~~~~~~ [at] ~~~~.~~~"), ("email", "inbox: ~~~~.~~~ AT ~~~~~ DOT ~~"),
    ("none", "sat at ~~~~~.~~~~~ once"), ("none", "sells at ~~~.~~ more"), ("none", "pointed at ~~~~~ and"),
    ("phone", "reach us under ###-###-####, please"), ("phone", "(###) ###-#### works"), ("phone", "hotline ### ### ####"), ("phone", "+## #### ######"), ("phone", "landline 0## #### #### is"), ("phone", "text +1 ### ### ####"), ("phone", "desk ###.###.####"),
    ("none", "was made ####-##-## ##:##:## here"), ("none", "since ##/##/####,"), ("none", "between #### and ####"), ("none", "catalogue item ###-###-#### in"), ("none", "tracking no. ############"), ("none", "total # ### ### units"), ("none", "isbn ###-##-####-###-#"), ("none", "code ###-##-####"), ("none", "id ##########"), ("none", "sum ##########.##"),
    ("card", "pay with #### #### #### ###$ now"), ("card", "charged ####-####-####-###$"), ("card", "amex #### ###### ####$"), ("card", "number ###############$ expired"),
    ("none", "voucher ####-####-####-####"), ("none", "hash ################ ends"), ("none", "serial no. #### #### ####"),
    ("ip", "ping %[.]%[.]%[.]% twice"), ("ip", "route % . % . % . %"), ("ip", "blocked %(.)%(.)%(.)%"),
    ("card", "seat ## ⟦#### #### #### ###$⟧ of"), ("card", "⟦###############$⟧ ## left"), ("card", "in ## ⟦####-####-####-###$⟧ by"), ("card", "⟦#### #### #### ###$⟧ ### ### #### too"), ("card", "%[.]%[.]%[.]% ⟦#### #### #### ###$⟧ it"),
    ("phone", "row ## ⟦###-###-####⟧ and"), ("phone", "#### ⟦(###) ###-####⟧ or"), ("phone", "⟦### ### ####⟧ ### ### #### both"), ("phone", "⟦###-###-####⟧ #### #### #### #### it"),
    ("ip", "⟦%[.]%[.]%[.]%⟧ #### #### #### #### so"), ("ip", "a ⟦%[.]%[.]%[.]%⟧ (###) ###-#### b"),
    ("none", "release #.#.#.# is"), ("none", "chapters # . # . # . #"),
)
VARIANTS = 40
TREES, DEPTH, RATE = 30, 3, 0.4
PRECISION = 0.9


def examples(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """VARIANTS texts of each template, drawn by hash: (kind, text, s, e), the last two bounding an enclosed item."""
    table = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).alias("t")) for k, t in templates))
    one = spark.range(len(templates) * VARIANTS).select("id", F.get(table, (F.col("id") % len(templates)).cast("int")).alias("x")).select("id", "x.*")
    drawn = lambda i, top: F.pmod(F.xxhash64(F.col("id"), i), F.lit(top)).cast("string")
    letter = lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(F.xxhash64(F.col("id"), i), F.lit(26)).cast("int") + 1, F.lit(1))
    chars = F.transform(F.split("t", ""), lambda c, i: F.when(c == "#", drawn(i, 10)).when(c == "%", F.when(F.pmod(F.xxhash64(F.col("id"), i), F.lit(255)) < 10, F.lit("10")).otherwise(drawn(i, 256))).when(c == "~", letter(i)).otherwise(c))
    text = one.withColumn("text", F.array_join(chars, ""))
    head = F.regexp_replace(F.regexp_extract("text", r"[0-9][0-9 .-]*(?=\$)", 0), "[^0-9]", "")
    summed = F.aggregate(F.transform(F.split(F.reverse(head), ""), lambda c, i: F.when(i % 2 == 0, (2 * c.cast("int")) - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))), F.lit(0), lambda a, b: a + b)
    last = F.when(F.col("t").rlike(r"#\$"), F.regexp_replace("text", r"(?<=[0-9])\$", ((10 - summed % 10) % 10).cast("string"))).otherwise(F.col("text"))
    bound = lambda mark, off: F.when(last.contains(mark), F.instr(last, mark) - off)
    return text.select("kind", F.translate(last, "⟦⟧", "").alias("text"), bound("⟦", 1).alias("s"), bound("⟧", 2).alias("e"))


class Leaf(NamedTuple):
    value: float


class Split(NamedTuple):
    feature: int
    at: int
    low: Split | Leaf
    high: Split | Leaf


def _value(node: Split | Leaf, x: tuple[int, ...]) -> float:
    while isinstance(node, Split):
        node = node.low if x[node.feature] <= node.at else node.high
    return node.value


def _grow(rows: list[tuple[tuple[int, ...], float, float]], depth: int) -> Split | Leaf:
    """A tree of the greatest second-order gain over (features, gradient, curvature) rows; ties go to the first split."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    gain_of = lambda a, b: a * a / (b + 1.0)
    best = (1e-6, None)
    for f in range(len(NAMES)) if depth else ():
        sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for x, a, b in rows:
            sums[x[f]][0] += a
            sums[x[f]][1] += b
        low_g = low_h = 0.0
        for v in sorted(sums)[:-1]:
            low_g, low_h = low_g + sums[v][0], low_h + sums[v][1]
            gain = gain_of(low_g, low_h) + gain_of(g - low_g, h - low_h) - gain_of(g, h)
            if gain > best[0] + 1e-9:
                best = gain, (f, v)
    if best[1] is None:
        return Leaf(RATE * g / (h + 1.0))
    f, v = best[1]
    return Split(f, v, _grow([r for r in rows if r[0][f] <= v], depth - 1), _grow([r for r in rows if r[0][f] > v], depth - 1))


def boost(counts: dict[tuple[int, ...], tuple[int, int]], trees: int = TREES, depth: int = DEPTH) -> list[Split | Leaf]:
    """Gradient-boosted trees of the logistic loss over distinct feature rows with (other, own) counts."""
    score = dict.fromkeys(counts, 0.0)
    out = []
    for _ in range(trees):
        rows = []
        for x, (other, own) in sorted(counts.items()):
            p = 1 / (1 + math.exp(-score[x]))
            rows.append((x, own - (own + other) * p, (own + other) * p * (1 - p)))
        out.append(_grow(rows, depth))
        for x in score:
            score[x] += _value(out[-1], x)
    return out


class Model(NamedTuple):
    """For each kind its trees and the least summed score that selects a span."""

    trees: tuple[tuple[Split | Leaf, ...], ...]
    thresholds: tuple[float, ...]


def fit(spark: SparkSession) -> Model:
    """Trees for each kind, learned from the candidates of TEMPLATES (a bounded number of distinct feature rows on the driver),
    with thresholds calibrated on those of CALIBRATION, which no tree has seen: halfway under the least positive score from
    which on PRECISION of the candidates are of the kind. A part of a run is of the kind only if it is the enclosed item; what
    stands beside that teaches nothing. The result is the same in every session."""
    both = examples(spark, TEMPLATES).withColumn("test", F.lit(False)).unionByName(examples(spark, CALIBRATION).withColumn("test", F.lit(True)))
    drawn = both.select("kind", "test", "s", "e", F.explode(candidates(F.col("text"))).alias("c")).where("s is null or (c.s < e and s < c.e)")
    own = F.coalesce((F.col("c.s") == F.col("s")) & (F.col("c.e") == F.col("e")), (F.col("c.before") == 0) & (F.col("c.after") == 0))
    seen = drawn.withColumn("kind", F.when(own, F.col("kind")).otherwise("none")).groupBy("kind", "test", *(F.col(f"c.{n}").alias(n) for n in NAMES)).agg(F.count("*").alias("n")).collect()
    trees, thresholds = [], []
    for kind in KINDS:
        parts: dict[bool, dict[tuple[int, ...], list[int]]] = {t: defaultdict(lambda: [0, 0]) for t in (False, True)}
        for r in seen:
            parts[r.test][tuple(r[n] for n in NAMES)][r.kind == kind] += r.n
        own = boost({x: tuple(c) for x, c in parts[False].items()})
        scored = sorted(((sum(_value(t, x) for t in own), c) for x, c in parts[True].items()), key=lambda s: -s[0])
        hit = miss = 0
        least = math.inf
        for i, (score, (other, good)) in enumerate(scored):
            hit, miss = hit + good, miss + other
            if score > 0 and hit >= PRECISION * (hit + miss):
                least = (score + max(0.0, scored[i + 1][0] if i + 1 < len(scored) else 0.0)) / 2
        trees.append(tuple(own))
        thresholds.append(least)
    return Model(tuple(trees), tuple(thresholds))


def _flat(node: Split | Leaf, depth: int) -> tuple[list[int], list[int], list[float]]:
    """A tree as a full one in level order: feature and bound of each split, and the leaves; what stops early is repeated."""
    level, features, bounds = [node], [], []
    for _ in range(depth):
        features += [n.feature if isinstance(n, Split) else 0 for n in level]
        bounds += [n.at if isinstance(n, Split) else 1 << 30 for n in level]
        level = [x for n in level for x in ((n.low, n.high) if isinstance(n, Split) else (n, n))]
    return features, bounds, [n.value for n in level]


def _score(trees: tuple[Split | Leaf, ...], x: Column) -> Column:
    """The summed score of a candidate's array of features. The trees are one literal, so that a plan stays small."""
    flat = json.dumps([dict(zip("fav", _flat(t, DEPTH), strict=True)) for t in trees])
    table = F.from_json(F.lit(flat), "array<struct<f:array<int>,a:array<int>,v:array<double>>>")
    down = lambda t, i: 2 * i + 1 + (F.get(x, F.get(t["f"], i)) > F.get(t["a"], i)).cast("int")

    def leaf(t: Column, i: Column, depth: int) -> Column:
        return F.get(t["v"], i - (2**DEPTH - 1)) if depth == 0 else let(down(t, i), lambda j: leaf(t, j, depth - 1))

    return F.aggregate(table, F.lit(0.0), lambda s, t: s + leaf(t, F.lit(0), DEPTH))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """docs with base (array of (s, e, kind), kind 0 to 3) and found (the same with the model's spans), row by row in the JVM.

    A candidate takes the kind whose score exceeds its threshold by most; one that overlaps a base span adds nothing. Others
    are swept by their start: of two that overlap the one of the earlier generator stays, then the one that exceeds its
    threshold by more, then the longer, then the earlier. Overlaps are found by binary search and running maxima, so a
    text full of matches takes little more than its share of time. Null texts are empty and have no spans. Columns named
    base and found are replaced; repeated rows each come back; an empty table gives no rows.
    """
    text = filled(F.col("text"))
    kept = [c for c in docs.columns if c.lower() not in ("base", "found")]
    rows = docs.select(*kept, *(b.alias(f"__{k}") for k, b in zip(KINDS, base(text), strict=True)), candidates(text).alias("__c"))
    named = lambda i: lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("kind"), x["e"].alias("e"))
    rows = rows.withColumn("base", F.sort_array(F.concat(*(F.transform(f"__{k}", named(i)) for i, k in enumerate(KINDS)))))
    steps = F.array(*(F.lit(1 << b) for b in range(25, -1, -1)))

    def outside(spans_: Column) -> Column:
        """Candidates that overlap none of the spans, which are sorted by start. What lambdas read is bound by let(): a column
        would be computed anew for each element where the optimizer merges projections."""
        ends = F.transform(spans_, lambda b: b["e"])
        upto = let(ends, lambda e: F.concat(scan(e, F.lit(0), lambda x, y: F.greatest(x, y)), F.array(F.array_max(e))))
        ahead = lambda b, c: F.aggregate(steps, F.lit(0), lambda n, k: F.when((n + k <= F.size(b)) & (F.get(b, n + k - 1)["s"] < c["e"]), n + k).otherwise(n))  # noqa: E731  # spans that start before c ends
        return let(spans_, lambda b: let(upto, lambda m: F.filter("__c", lambda c: let(ahead(b, c), lambda n: (n == 0) | (F.get(m, n) <= c["s"])))))

    free = F.when((F.size("base") == 0) | (F.size("__c") == 0), F.col("__c")).otherwise(outside(F.col("base")))

    def judged(c: Column) -> Column:
        margins = lambda x: F.array(*(_score(trees, x) - F.lit(least if math.isfinite(least) else 1e9) for trees, least in zip(model.trees, model.thresholds, strict=True)))
        best = lambda m: F.struct(F.array_max(m).alias("top"), (F.array_position(m, F.array_max(m)) - 1).cast("int").alias("kind"))
        out = lambda x: F.struct(c["s"].alias("s"), F.struct(c["generator"].alias("g"), F.round(-x["top"], 9).alias("over"), (c["s"] - c["e"]).alias("size")).alias("rank"), F.when(x["top"] >= 0, x["kind"]).otherwise(-1).alias("kind"), c["e"].alias("e"))
        return let(let(let(F.array(*(c[n] for n in NAMES)), margins), best), out)

    judged_ = "array<struct<s:int,rank:struct<g:int,over:double,size:int>,kind:int,e:int>>"
    rows = rows.withColumn("__f", F.when(F.size("__c") == 0, F.array().cast(judged_)).otherwise(F.sort_array(F.filter(F.transform(free, judged), lambda c: c["kind"] >= 0).cast(judged_))))

    def sweep(chain: Column) -> Column:
        last = lambda kept: F.element_at(kept, -1)
        rest = lambda kept: F.slice(kept, 1, F.size(kept) - 1)
        return F.aggregate(chain, F.array().cast(judged_), lambda kept, c: F.when((F.size(kept) == 0) | (F.get(kept, F.size(kept) - 1)["e"] <= c["s"]), F.concat(kept, F.array(c))).when(c["rank"] < last(kept)["rank"], F.concat(rest(kept), F.array(c))).otherwise(kept))

    def chains(f: Column, m: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(f) - 1), lambda i: F.get(m, i) <= F.get(f, i)["s"])
        return let(firsts, lambda at: F.transform(at, lambda b, k: F.slice(f, b + 1, F.coalesce(F.get(at, k + 1), F.size(f)) - b)))

    reach = lambda f: scan(F.transform(f, lambda c: c["e"]), F.lit(0), lambda x, y: F.greatest(x, y))
    swept = let(F.col("__f"), lambda f: let(reach(f), lambda m: F.flatten(F.transform(chains(f, m), sweep))))
    first = F.when(F.size("__f") == 0, F.array().cast(judged_)).otherwise(swept)
    added = F.transform(first, lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e")))
    return rows.withColumn("found", F.sort_array(F.concat("base", added))).select(*kept, "base", "found")


def as_text(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row of docs; other
    columns are ignored, an empty table gives no rows."""
    found = find(docs.select("doc_id", "text"), model)
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"))


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the spans of text replaced by their kind in brackets; overlapping spans become one, named by the first.
    Null texts stay null; texts without a span stay as they are."""
    rows = find(docs, model)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    piece = lambda m: lambda x, i: F.when(x["s"] < F.get(m, i), "").otherwise(F.concat(F.substring("text", F.get(m, i) + 1, x["s"] - F.get(m, i)), F.get(names, x["kind"])))
    pieces = let(F.transform("found", lambda x: x["e"]), lambda e: let(scan(e, F.lit(0), lambda x, y: F.greatest(x, y)), lambda m: F.concat(F.array_join(F.transform("found", piece(m)), ""), F.substring("text", F.array_max(e) + 1, F.length("text")))))
    text = F.when(F.size("found") == 0, F.col("text")).otherwise(pieces)
    return rows.withColumn("text", text).select(*docs.columns)
