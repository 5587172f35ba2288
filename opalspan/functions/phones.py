"""Telephone numbers by numbering plans: a trie of prefixes, the longest one that a number begins with decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opalspan.functions.spans import SPANS, let, matches

#: Fixed values from the public plans of the North American, British and Indian administrations: prefixes of national
#: numbers, the fewest and most digits of such a number, and its kind.
_GB = (
    ("1", 9, 10, "fixed"), ("2", 10, 10, "fixed"), ("3", 10, 10, "uan"), ("55", 10, 10, "uan"), ("56", 10, 10, "voip"), ("70", 10, 10, "personal"),
    ("71", 10, 10, "mobile"), ("72", 10, 10, "mobile"), ("73", 10, 10, "mobile"), ("74", 10, 10, "mobile"), ("75", 10, 10, "mobile"), ("76", 10, 10, "pager"),
    ("77", 10, 10, "mobile"), ("78", 10, 10, "mobile"), ("79", 10, 10, "mobile"), ("7624", 10, 10, "mobile"), ("80", 9, 10, "free"), ("84", 10, 10, "shared"),
    ("87", 10, 10, "shared"), ("90", 10, 10, "premium"), ("91", 10, 10, "premium"), ("982", 10, 10, "premium"), ("983", 10, 10, "premium"), ("984", 10, 10, "premium"), ("989", 10, 10, "premium"),
    ("10", 0, 0, "none"), ("19", 9, 10, "fixed"), ("21", 0, 0, "none"), ("22", 0, 0, "none"), ("25", 0, 0, "none"), ("26", 0, 0, "none"), ("27", 0, 0, "none"),
    ("31", 0, 0, "none"), ("32", 0, 0, "none"), ("35", 0, 0, "none"), ("36", 0, 0, "none"), ("38", 0, 0, "none"), ("39", 0, 0, "none"),
)
_IN = (
    ("1", 10, 10, "fixed"), ("2", 10, 10, "fixed"), ("3", 10, 10, "fixed"), ("4", 10, 10, "fixed"), ("5", 10, 10, "fixed"), ("6", 10, 10, "mobile"),
    ("7", 10, 10, "mobile"), ("8", 10, 10, "mobile"), ("9", 10, 10, "mobile"), ("10", 0, 0, "none"), ("1800", 8, 13, "free"), ("1860", 11, 11, "shared"),
)
#: Area codes of the North American plan that are Canada's, those of other countries and territories in it,
#: and those without a place.
CANADA = "204 226 236 249 250 257 263 289 306 343 354 365 367 368 382 403 416 418 428 431 437 438 450 468 474 506 514 519 548 579 581 584 587 604 613 639 647 672 683 705 709 742 753 778 780 782 807 819 825 867 873 879 902 905 942".split()
ISLANDS = "242 246 264 268 284 340 345 441 473 649 658 664 670 671 684 721 758 767 784 787 809 829 849 868 869 876 939".split()
NO_PLACE = {"800": "free", "833": "free", "844": "free", "855": "free", "866": "free", "877": "free", "888": "free", "900": "premium", "500": "personal", "521": "personal", "522": "personal", "533": "personal", "544": "personal", "566": "personal", "577": "personal", "588": "personal"}
#: Other countries' codes with the fewest and most digits of their national numbers, from public plans; they
#: are known by their code alone.
ABROAD = {
    "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9),
    "43": (5, 13), "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (6, 12), "52": (10, 10), "54": (10, 11), "55": (10, 11), "57": (8, 10), "60": (8, 10), "61": (9, 9),
    "62": (8, 12), "63": (8, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 10), "84": (9, 10), "86": (10, 11), "90": (10, 10), "92": (9, 10), "94": (9, 9),
    "234": (8, 10), "254": (9, 9), "351": (9, 9), "353": (7, 9), "354": (7, 7), "358": (5, 11), "380": (9, 9), "420": (9, 9), "852": (8, 8), "880": (8, 10), "886": (8, 9), "966": (8, 9), "971": (8, 9), "972": (8, 9),
}


def _north_american() -> list[tuple[str, int, int, str, str]]:
    """Area codes by the plan's rules: 200 to 999 without a 9 in the middle, without two ones at the end, and without the
    blocks 37x and 96x, which are held back."""
    out = []
    for n in range(200, 1000):
        area = str(n)
        if area[1] == "9" or area[1:] == "11" or area[:2] in ("37", "96"):
            continue
        region = "CA" if area in CANADA else "001" if area in ISLANDS or area in NO_PLACE else "US"
        out.append(("1" + area, 10, 10, NO_PLACE.get(area, "any"), region))
    return out


def plan() -> list[tuple[str, int, int, str, str]]:
    """(prefix from the country code on, fewest and most national digits, kind, region), each prefix once."""
    rows = _north_american()
    rows += [("44" + p, low, high, kind, "GB") for p, low, high, kind in _GB] + [("91" + p, low, high, kind, "IN") for p, low, high, kind in _IN]
    return rows + [(code, low, high, "any", "001") for code, (low, high) in ABROAD.items()]


#: Regions, in the order in which a number without a country's code is read: code, what stands before a number at home and
#: whether it must, and what stands before a foreign country's code.
REGIONS = {"US": ("1", "1", False, "011"), "GB": ("44", "0", True, "00"), "CA": ("1", "1", False, "011"), "IN": ("91", "0", False, "00")}
#: Candidates, with their neighbours; digits in groups, a code of an area in brackets, white space of one.
CANDIDATE = r"(?U)(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\([0-9]{2,5}\)[ .-]?)?\d{2,6}(?:[ .-]?\d{2,6}){1,4}(?![\w-])"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _table() -> dict[str, tuple[int, int, str, str]]:
    return {p: (low, high, kind, region) for p, low, high, kind, region in plan()}


def known(number: Column) -> Column:
    """A number with its country's code, as digits -> struct(region, kind), or null if no plan has it.

    The trie has two levels: a map by the first two digits, of maps by whole prefixes, looked up from the longest on: the
    first that is there decides, as a walk down would. A North American subscriber's exchange begins with 2 to 9 and does
    not end in two ones.
    """
    table = _table()
    nodes: dict[str, dict] = {}
    for p, row in table.items():
        for first in [p[:2]] if len(p) > 1 else [p + str(k) for k in range(10)]:
            nodes.setdefault(first, {})[p] = row
    leaf = lambda p, low, high, kind, region: F.struct(F.lit(len(p)).alias("size"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(kind).alias("kind"), F.lit(region).alias("region"))
    trie = F.create_map(*[x for first, node in nodes.items() for x in (F.lit(first), F.create_map(*[y for p, row in node.items() for y in (F.lit(p), leaf(p, *row))]))])
    codes = {"1", "44", "91", *ABROAD}

    def entry(d: Column) -> Column:
        return let(F.try_element_at(trie, F.left(d, F.lit(2))), lambda node: F.coalesce(*[F.try_element_at(node, F.left(d, F.lit(n))) for n in range(max(map(len, table)), 0, -1)]))

    code = lambda d: F.coalesce(*[F.when(F.left(d, F.lit(n)).isin(sorted(c for c in codes if len(c) == n)), n) for n in (3, 2, 1)])

    def judged(d: Column) -> Column:
        def by(e: Column) -> Column:
            national = F.length(d) - code(d)
            exchange = ~d.startswith("1") | F.substring(d, 5, 3).rlike("^[2-9](?!11)[0-9]{2}$")
            return F.when(e.isNotNull() & (F.length(d) > e["size"]) & national.between(e["low"], e["high"]) & exchange, F.struct(e["region"].alias("region"), e["kind"].alias("kind")))

        return let(entry(d), by)

    return let(number, judged)


def readings(value: Column, regions: tuple[str, ...] = tuple(REGIONS)) -> Column:
    """What a number as written may be with its country's code: itself after a plus, else by each region in turn."""
    d = digits(value)
    tried = []
    for r in regions:
        code, before, must, abroad = REGIONS[r]
        foreign = F.when(d.startswith(abroad), F.substr(d, F.lit(len(abroad) + 1)))
        own = F.when(d.startswith(before), F.concat(F.lit(code), F.substr(d, F.lit(len(before) + 1))))
        tried += [foreign, own] + ([] if must else [F.concat(F.lit(code), d)])
    return F.when(value.startswith("+"), F.array(d)).otherwise(F.filter(F.array(*tried), lambda x: x.isNotNull()))


def read(value: Column, regions: tuple[str, ...] = tuple(REGIONS)) -> Column:
    """struct(number, region, kind) of the first reading that a plan has, null if none has one."""
    each = F.transform(readings(value, regions), lambda n: let(known(n), lambda k: F.when(k.isNotNull(), F.struct(n.alias("number"), k["region"].alias("region"), k["kind"].alias("kind")))))
    return F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))


def phones_by_plan(text: Column, regions: tuple[str, ...] = tuple(REGIONS)) -> Column:
    """Spans of candidates that some plan has; one span a place, whichever region reads it first. Null gives none."""
    found = F.filter(matches(F.coalesce(text, F.lit("")), CANDIDATE, "TELEPHONENUM"), lambda s: read(s["text"], regions).isNotNull())
    return found.cast(SPANS)
