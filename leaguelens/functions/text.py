"""Names, teams and positions as column expressions.

Everything is native except accent folding and the sequence similarity, which are Arrow
batched: Spark has no Unicode decomposition and no Ratcliff-Obershelp ratio.
"""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Codes and aliases that results must agree on.
ALLOWED_POSITIONS = ("QB", "RB", "WR", "TE", "DST", "K")
POSITION_ALIASES = {
    "QB": "QB", "RB": "RB", "WR": "WR", "TE": "TE", "K": "K", "PK": "K",
    "DST": "DST", "D/ST": "DST", "DEF": "DST", "DEFENSE": "DST", "FB": "RB", "HB": "RB",
}
TEAM_ALIASES = {
    "SD": "LAC", "SAN DIEGO": "LAC", "SAN DIEGO CHARGERS": "LAC",
    "STL": "LAR", "ST LOUIS": "LAR", "ST LOUIS RAMS": "LAR",
    "OAK": "LV", "OAKLAND": "LV", "OAKLAND RAIDERS": "LV",
    "WSH": "WAS", "WSN": "WAS", "WFT": "WAS", "WASHINGTON FOOTBALL TEAM": "WAS", "WASHINGTON REDSKINS": "WAS",
    "JAC": "JAX",
}
SUFFIXES = ("JR", "SR", "II", "III", "IV", "V")
POSITION_ORDER = ("QB", "RB", "WR", "TE", "FLEX", "DEF")


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Canonical decomposition without combining marks."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def fold_ascii(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, ASCII characters only."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of ``a`` to ``b``; the order of arguments matters."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def normalize_name(name: Column, keep_digits: bool = False, fold: bool = True) -> Column:
    """Lower case, accents and one trailing generation suffix gone, only letters, spaces and hyphens left."""
    x = F.lower(F.trim(name))
    x = strip_accents(x) if fold else x
    x = F.regexp_replace(x, r"\s+(?:jr|sr|ii|iii|iv|v)\.?$", "")
    x = F.regexp_replace(x, r"[^a-z0-9\s-]" if keep_digits else r"[^a-z\s-]", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_text(text: Column, fold: bool = True) -> Column:
    """Upper-case ASCII words separated by single spaces."""
    x = F.upper(fold_ascii(text) if fold else text)
    return F.trim(F.regexp_replace(x, "[^A-Z0-9]+", " "))


def normalize_player_name(name: Column, fold: bool = True) -> Column:
    """``normalize_text`` without suffix words, wherever they stand."""
    words = F.split(normalize_text(name, fold), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*SUFFIXES)), " ")


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.try_element_at(pairs, key)


def normalize_team_code(team: Column, fold: bool = True) -> Column:
    """Today's code of a team; unknown names stay."""
    x = normalize_text(team, fold)
    return F.coalesce(_lookup(x, TEAM_ALIASES), x)


def normalize_position(position: Column, fold: bool = True) -> Column:
    """Standard position code; unknown ones stay."""
    x = normalize_text(position, fold)
    return F.coalesce(_lookup(x, POSITION_ALIASES), x)


def compact(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def first_last(name: Column) -> Column:
    """Struct (first, last) of the outer words; both empty with fewer than two words."""
    words = F.split(F.trim(name), r"\s+")
    two = F.size(words) >= 2
    return F.struct(
        F.when(two, F.element_at(words, 1)).otherwise("").alias("first"),
        F.when(two, F.element_at(words, -1)).otherwise("").alias("last"),
    )


def same_prefix(a: Column, b: Column, n: int = 3) -> Column:
    """Both have ``n`` characters and agree on them."""
    return (F.length(a) >= n) & (F.length(b) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n))


def starts_with_phrase(candidate: Column, phrase: Column) -> Column:
    return (candidate == phrase) | candidate.startswith(F.concat(phrase, F.lit(" ")))


def slugify(text: Column, suffix: Column | None = None) -> Column:
    """Lower-case words joined by hyphens, and an optional ``_suffix``."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return slug if suffix is None else F.concat_ws("_", slug, F.lower(suffix))


def title_of_slug(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def split_player_field(raw: Column) -> Column:
    """Struct (name, team, bye) of a cell such as ``Name  TEAM (9)``."""
    bye = F.try_to_number(F.nullif(F.regexp_extract(raw, r"\((\d+)\)\s*$", 1), F.lit("")), F.lit("99"))
    rest = F.trim(F.regexp_replace(raw, r"\s*\(\d+\)\s*$", ""))
    team = F.nullif(F.regexp_extract(rest, r"\s+([A-Z]{2,3})$", 1), F.lit(""))
    return F.struct(F.trim(F.regexp_replace(rest, r"\s+[A-Z]{2,3}$", "")).alias("name"), team.alias("team"), bye.cast("bigint").alias("bye"))


def position_order(position: Column) -> Column:
    """1 for QB to 6 for DEF, 99 for others."""
    out = F.when(position == POSITION_ORDER[0], 1)
    for i, p in enumerate(POSITION_ORDER[1:], 2):
        out = out.when(position == p, i)
    return out.otherwise(99)


# Code, city, nickname, other names of each team.
TEAM_NAMES = (
    ("ARI", "Arizona", "Cardinals", "ARZ", "CRD"),
    ("ATL", "Atlanta", "Falcons", "FAL"),
    ("BAL", "Baltimore", "Ravens", "RAV"),
    ("BUF", "Buffalo", "Bills", "BIL"),
    ("CAR", "Carolina", "Panthers"),
    ("CHI", "Chicago", "Bears"),
    ("CIN", "Cincinnati", "Bengals"),
    ("CLE", "Cleveland", "Browns"),
    ("DAL", "Dallas", "Cowboys"),
    ("DEN", "Denver", "Broncos"),
    ("DET", "Detroit", "Lions"),
    ("GB", "Green Bay", "Packers", "GNB"),
    ("HOU", "Houston", "Texans", "HTX"),
    ("IND", "Indianapolis", "Colts", "CLT"),
    ("JAX", "Jacksonville", "Jaguars"),
    ("KC", "Kansas City", "Chiefs", "KAN"),
    ("LAC", "Los Angeles", "Chargers", "SDG", "LA Chargers", "San Diego"),
    ("LAR", "Los Angeles", "Rams", "RAM", "LA Rams", "St. Louis"),
    ("LV", "Las Vegas", "Raiders", "RAI", "Oakland"),
    ("MIA", "Miami", "Dolphins"),
    ("MIN", "Minnesota", "Vikings"),
    ("NE", "New England", "Patriots", "NWE"),
    ("NO", "New Orleans", "Saints", "NOR"),
    ("NYG", "New York", "Giants", "NY Giants"),
    ("NYJ", "New York", "Jets", "NY Jets"),
    ("PHI", "Philadelphia", "Eagles"),
    ("PIT", "Pittsburgh", "Steelers"),
    ("SEA", "Seattle", "Seahawks"),
    ("SF", "San Francisco", "49ers", "SFO"),
    ("TB", "Tampa Bay", "Buccaneers", "TAM"),
    ("TEN", "Tennessee", "Titans", "OTI"),
    ("WAS", "Washington", "Commanders", "Washington Football Team"),
)


def team_spellings() -> dict[str, str]:
    """Every spelling of a team, in lower case, with its code; a city of two teams is none."""
    cities = [t[1] for t in TEAM_NAMES]
    out = {}
    for code, city, nickname, *others in TEAM_NAMES:
        names = [code, nickname, f"{city} {nickname}", *others] + [city] * (cities.count(city) == 1)
        out |= {n.lower(): code for n in names}
    return out


def team_code_of_name(team: Column) -> Column:
    """The code of a team by any of its spellings; other text stays."""
    return F.coalesce(_lookup(F.lower(F.trim(team)), team_spellings()), team)
