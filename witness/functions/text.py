"""Text rules as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hazard classes of reports, first match wins.
HAZARD_RULES = (
    ("flooding", r"\b(flood(ing|ed)?|surface water|inundat|deluge|downpour|storm ?water|ponding)\b"),
    ("landslide", r"\b(landslip|land ?slide|slip|slump|debris flow|rockfall|washout)\b"),
    ("earthquake", r"\b(earthquake|quake|aftershock|shaking|seismic|tremor)\b"),
    ("fire", r"\b(fire|blaze|smoke|burning|scrub fire)\b"),
    ("wind", r"\b(gale|wind(s|y)?|gust|tornado|severe wind)\b"),
    ("power", r"\b(power (cut|out)|outage|blackout|no electricity|lines down)\b"),
    ("water", r"\b(burst (pipe|main)|water main|no water|blockage|waste ?water|sewage|leak)\b"),
    ("transport", r"\b(road closed|closure|crash|detour|traffic|rail|train|ferry|bus)\b"),
    ("coastal", r"\b(storm surge|king tide|swell|tsunami|coastal (erosion|inundation))\b"),
)
# Hazard hints of feed posts, first match wins.
FEED_HAZARD_RULES = (
    ("flooding", r"flood|under ?water|surface water|ponding|inundat|water over|burst.*(bank|pipe|main)"),
    ("wind", r"wind|gale|gust|roof (iron|lifting|off)|tree (down|fallen)|blown"),
    ("earthquake", r"earthquake|quake|shaking|felt report|seismic|aftershock"),
    ("landslip", r"slip|landslide|landslip|rockfall|bank collapsed"),
    ("power_outage", r"power (out|cut|outage)|no power|lines down|blackout"),
    ("road", r"road (closed|blocked)|crash|collision|traffic|detour|highway|sh[12]\b"),
    ("coastal_inundation", r"storm surge|king tide|waves? over|coastal flood|swell"),
)
# Places with approximate centres (longitude, latitude).
GAZETTEER = {
    "aro valley": (174.7627, -41.2953), "berhampore": (174.7748, -41.3241), "brooklyn": (174.7625, -41.3061),
    "karori": (174.7397, -41.2847), "kelburn": (174.7666, -41.2896), "khandallah": (174.7906, -41.2436),
    "island bay": (174.7739, -41.3395), "johnsonville": (174.8036, -41.2264), "kilbirnie": (174.7936, -41.3164),
    "lyall bay": (174.7955, -41.3283), "miramar": (174.8158, -41.3163), "newtown": (174.7797, -41.3106),
    "ngaio": (174.7736, -41.2504), "oriental bay": (174.7896, -41.2925), "petone": (174.8712, -41.2226),
    "seatoun": (174.8324, -41.3243), "strathmore": (174.8207, -41.3287), "tawa": (174.8262, -41.1697),
    "te aro": (174.7762, -41.2954), "thorndon": (174.7784, -41.2735), "wadestown": (174.7676, -41.2678),
    "wellington cbd": (174.7762, -41.2865), "wellington central": (174.7762, -41.2865), "hataitai": (174.7947, -41.3053),
    "mount victoria": (174.7877, -41.2955), "mount cook": (174.7735, -41.3012), "newlands": (174.8175, -41.2137),
    "churton park": (174.8047, -41.1946), "porirua": (174.8402, -41.1339), "lower hutt": (174.9165, -41.2088),
    "upper hutt": (175.0709, -41.1244), "taita": (174.9556, -41.1793), "wainuiomata": (174.9498, -41.2624),
    "eastbourne": (174.9033, -41.2916), "makara": (174.7078, -41.2372), "owhiro bay": (174.7565, -41.3444),
    "houghton bay": (174.7861, -41.3428), "roseneath": (174.7994, -41.2896), "pipitea": (174.7817, -41.276),
    "pōneke": (174.7762, -41.2865), "poneke": (174.7762, -41.2865),
}
# Names that feeds are searched for, and those that stand for several places.
FEED_PLACES = (
    "Wellington", "Karori", "Kelburn", "Thorndon", "Te Aro", "Newtown", "Miramar", "Kilbirnie", "Island Bay", "Brooklyn",
    "Hataitai", "Johnsonville", "Khandallah", "Ngaio", "Tawa", "Porirua", "Lower Hutt", "Upper Hutt", "Petone", "Seatoun",
    "Lyall Bay", "Berhampore", "Wadestown", "Northland", "Eastbourne", "Wainuiomata", "Naenae", "Taita", "Ngauranga",
    "Silverstream", "Trentham", "Korokoro", "Paraparaumu", "Alicetown", "Pauatahanui",
)
AMBIGUOUS_PLACES = ("Northland", "Brooklyn", "Newtown")
# Hint terms of the impact search.
IMPACT_TERMS = (
    "flood", "flooding", "slip", "landslide", "surface flooding", "road closed", "closure", "closed", "power cut", "power out",
    "outage", "no power", "blackout", "water main", "burst", "no water", "boil water", "evacuat", "cordon", "storm", "gale",
    "wind", "damage", "debris", "tree down", "quake", "earthquake", "shake", "jolt", "tsunami", "swell", "king tide", "inundat",
    "sewage", "fire", "smoke", "crash", "cancelled", "disruption", "stranded", "rescue",
)
PLACE_TERMS = (
    "wellington", "te whanganui-a-tara", "welly", "wgtn", "karori", "kelburn", "thorndon", "te aro", "newtown", "miramar",
    "kilbirnie", "island bay", "brooklyn", "hataitai", "oriental bay", "mount victoria", "aro valley", "berhampore",
    "johnsonville", "khandallah", "ngaio", "tawa", "churton park", "porirua", "lower hutt", "upper hutt", "petone", "seatoun",
    "strathmore", "owhiro bay", "makara", "wadestown", "northland", "lyall bay", "rongotai", "hutt valley", "eastbourne",
    "wainuiomata", "naenae", "taita", "cbd",
)
# Warning levels by phrase, first match wins.
WARNING_LEVELS = (("red warning", "red"), ("orange warning", "orange"), ("watch", "watch"), ("warning", "warning"))
# Communities of the keep rule, and accounts that republish a feed.
LOCAL_SUBS = ("wellington",)
NATIONAL_SUBS = ("newzealand", "casualnz")
RELAYS = {"journeysbot@g2s.mountainmoss.nz": "NZTA Journeys"}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def stems(pattern: str) -> list[str]:
    """For each alternative of a rule the longest run of plain characters that every match of it has."""
    inner = re.fullmatch(r"\\b\((.*)\)\\b", pattern)
    open_, alternatives = 0, [""]
    for c in inner[1] if inner else pattern:
        open_ += (c == "(") - (c == ")")
        if c == "|" and not open_:
            alternatives.append("")
        else:
            alternatives[-1] += c
    bare = (re.sub(r"\([^()]*\)\??|\[[^]]*\]|\\.|.\?|\.\*|\.", "\0", x) for x in alternatives)
    return [max(x.split("\0"), key=len) for x in bare]


def first_rule(text: Column, rules: tuple, default: str | None) -> Column:
    """A rule's pattern is looked for only where the text has one of its ``stems``."""

    def pick(x: Column) -> Column:
        found = F.lit(None).cast("string") if default is None else F.lit(default)
        for name, pattern in reversed(rules):
            some = F.lit(False)
            for stem in dict.fromkeys(stems(pattern)):
                some = some | x["low"].contains(stem)
            found = F.when(some & x["text"].rlike(f"(?i){pattern}"), name).otherwise(found)
        return found

    text = F.coalesce(text, F.lit(""))
    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), pick)


def hazard_of(text: Column) -> Column:
    return first_rule(text, HAZARD_RULES, "other")


def feed_hazard_of(text: Column) -> Column:
    return first_rule(text, FEED_HAZARD_RULES, None)


def place_of(text: Column) -> Column:
    """The longest gazetteer name in the text (of equals, the first listed) at confidence 0.4, or null."""

    def pick(low: Column) -> Column:
        found = F.lit(None).cast("struct<place:string,lat:double,lng:double,confidence:double>")
        for name, (lng, lat) in reversed(sorted(GAZETTEER.items(), key=lambda x: -len(x[0]))):
            here = F.struct(F.lit(name).alias("place"), F.lit(lat).alias("lat"), F.lit(lng).alias("lng"), F.lit(0.4).alias("confidence"))
            found = F.when(low.contains(name) & low.rlike(rf"\b{name}\b"), here).otherwise(found)
        return found

    return let(F.lower(F.coalesce(text, F.lit(""))), pick)


def hits(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms that occur in the text, in the order given."""
    terms = tuple(dict.fromkeys(terms))
    lower = F.array(*(F.lit(t.lower()) for t in terms))
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.filter(F.array(*map(F.lit, terms)), lambda t, i: low.contains(F.get(lower, i))))


def sorted_hits(text: Column, terms: tuple[str, ...]) -> Column:
    return hits(text, tuple(sorted(set(terms))))


def text_location(text: Column) -> Column:
    """All names in a post; the first is the best guess; names of several places are marked."""
    found = hits(text, FEED_PLACES)
    odd = F.filter(found, lambda p: p.isin(*AMBIGUOUS_PLACES))
    return F.struct(
        found.alias("places"), F.try_element_at(found, F.lit(1)).alias("best_guess"), (F.size(found) > 0).alias("is_locatable"),
        F.when(F.size(odd) > 0, odd).alias("ambiguous"),
    )


def location_signal(check_in: Column, found: Column) -> Column:
    """What places a post: its check-in, else its text, else nothing."""
    return F.when(check_in.isNotNull(), "check_in").when(F.size(found) > 0, "text_mention").otherwise("none")


def check_in_conflict(check_in: Column, found: Column) -> Column:
    """A check-in at a place the text doesn't name, though it names others."""
    return F.coalesce(check_in.isNotNull() & (F.size(found) > 0) & ~F.array_contains(found, check_in), F.lit(False))


def keep_post(subreddit: Column, text: Column) -> Column:
    """A local group's posts, and those of a national one that name a local place."""
    sub = F.lower(F.coalesce(subreddit, F.lit("")))
    return sub.isin(*LOCAL_SUBS) | (sub.isin(*NATIONAL_SUBS) & (F.size(hits(text, PLACE_TERMS)) > 0))


def warning_level(text: Column) -> Column:
    low, found = F.lower(F.coalesce(text, F.lit(""))), F.lit(None).cast("string")
    for phrase, level in reversed(WARNING_LEVELS):
        found = F.when(low.contains(phrase), level).otherwise(found)
    return found


def pseudonym(handle: Column, salt: str) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.lower(handle)), 256)
    return F.when(handle != "", F.concat(F.lit("anon-"), F.left(digest, F.lit(12))))


def plain_pseudonym(handle: Column) -> Column:
    return F.when(handle != "", F.concat(F.lit("anon:"), F.left(F.sha2(handle, 256), F.lit(12))))


def urls(text: Column) -> Column:
    """Different http(s) links in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"""https?://[^\s<>"')]+"""), F.lit(0)))


# Units of measurement, and the pattern of a house number before a word that is none of them.
UNITS = "mm|cm|m|km|kpa|psi|l|ml|hr|hrs|hour|hours|min|mins|deg|inch|in|ft"
HOUSE_NUMBER = rf"\b\d{{1,5}}[A-Za-z]?(?:\s*[-/]\s*\d{{1,5}}[A-Za-z]?)?\s+(?=[A-Za-z])(?!(?i:{UNITS})\b)"


def redact_house_numbers(text: Column) -> Column:
    """House numbers before a word go; numbers of a measurement stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, HOUSE_NUMBER, ""), r"\s{2,}", " "))


def strip_html(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]+>", " "), r"\s+", " "))


def decode_entities(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


# How links to videos and pictures look.
VIDEO_LINK, PHOTO_LINK = r"(?i)(v\.redd\.it|youtube\.com|youtu\.be|\.mp4\b)", r"(?i)\.(jpg|jpeg|png|gif|webp)\b"


def media_of_post(content: Column, link: Column) -> Column:
    video, photo = content.rlike(VIDEO_LINK), content.rlike(PHOTO_LINK)
    return F.when(video, "video").when(photo, "photo").when(link.isNotNull(), "link").otherwise("none")


def media_of_embed(kind: Column) -> Column:
    k = F.coalesce(kind, F.lit(""))
    return F.when(k.contains("images"), "photo").when(k.contains("video"), "video").when(k.contains("external"), "link").otherwise("none")


def humanise(key: Column) -> Column:
    return F.trim(F.regexp_replace(key, "[_-]+", " "))


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, r"[.:;,\s]+$", "")


FORMATS = (
    "EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
)


def instant(text: Column) -> Column:
    """A timestamp from text in one of the known formats, else null; a list narrower than a browser's parser."""
    bare = F.regexp_replace(F.trim(text), "^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), ", "")
    known = [f.removeprefix("EEE, ") for f in FORMATS]
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in known))


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fingerprint(text: Column, blanks: bool = True, first: int = 200) -> Column:
    kept = F.regexp_replace(F.lower(text), "[^a-z ]" if blanks else "[^a-z]", "")
    return F.left(F.sha2(F.left(kept, F.lit(first)), 256), F.lit(12))


def independence_key(author: Column, publisher: Column) -> Column:
    """Accounts that relay a feed count as that feed."""
    relays = F.create_map(*(F.lit(x) for pair in RELAYS.items() for x in pair))
    origin = F.try_element_at(relays, author)
    return F.when(origin.isNotNull(), F.concat(F.lit("origin:"), origin)).otherwise(F.concat(F.lit("publisher:"), publisher))


def enrich_items(rows: DataFrame, text: str = "text") -> DataFrame:
    """All text rules at once, one pass over a corpus."""
    t = F.col(text)
    return rows.withColumns({
        "hazard": hazard_of(t), "feed_hazard": feed_hazard_of(t), "place": place_of(t), "location": text_location(t),
        "hint_places": sorted_hits(t, PLACE_TERMS), "hint_impacts": sorted_hits(t, IMPACT_TERMS), "links": urls(t),
        "warning": warning_level(t), "fingerprint": fingerprint(t),
    })
