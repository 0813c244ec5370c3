"""Fields out of what venues, feeds and reports send: tickers, titles, row sets, replies, pages of text."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import extract

#: Months in tickers (fixed values).
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
#: Words of market titles (fixed values).
VERSUS, OVER_UNDER, LEAGUE, BY_OVER = " vs", "O/U", " women's Pro Basketball game", " by over "
#: Labels of a feed's event codes (fixed values).
EVENTS: Mapping[int, str] = {
    1: "Made Shot", 2: "Missed Shot", 3: "Free Throw", 4: "Rebound", 5: "Turnover", 6: "Foul", 7: "Violation", 8: "Substitution",
    9: "Timeout", 10: "Jump Ball", 11: "Ejection", 12: "Period Begin", 13: "Period End", 18: "Instant Replay",
}


def ticker_date(ticker: Column) -> Column:
    """The day in a ticker (series, event and perhaps market, with dashes between; an event starts with its day); null
    where there is none or it isn't a day of the calendar."""
    dated = F.get(F.filter(F.slice(F.split(ticker, "-"), 2, 9), lambda x: x.rlike("^[0-9]{2}[A-Z]{3}[0-9]{2}[A-Z]*$")), F.lit(0))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(dated, 3, 3))
    text = F.concat_ws("-", F.concat(F.lit("20"), F.substring(dated, 1, 2)), F.lpad(month.cast("string"), 2, "0"), F.substring(dated, 6, 2))
    return F.when(month > 0, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def _number(word: Column) -> Column:
    """A word that is a number and nothing else; null for others."""
    return F.when(word.rlike("^[+-]?[0-9][0-9.]*$"), word.try_cast("double"))


def _without(text: Column, words: Sequence[str], end: bool) -> Column:
    """``text`` without the first of ``words`` that it ends (or starts) with; null where it doesn't."""
    out = F.lit(None).cast("string")
    for w in reversed(words):
        fits = F.endswith(text, F.lit(w)) if end else F.startswith(text, F.lit(w))
        cut = F.substring(text, F.lit(1), F.length(text) - len(w)) if end else F.substring(text, F.lit(len(w) + 1), F.length(text))
        out = F.when(fits, cut).otherwise(out)
    return out


def market_title(title: Column) -> Column:
    """(kind, team_a, team_b, player, prop, line) of a title; null where it is of no known kind.

    A title has a subject and, behind its first colon, what is asked of it; without a colon it is two teams or a
    sentence about a margin.  "15+" is 15 or more, so its line is half a point lower.
    """
    text = F.btrim(title)
    colon = F.instr(text, ":")
    subject = F.btrim(F.when(colon > 0, F.substring(text, F.lit(1), colon - 1)).otherwise(text))
    asked = F.when(colon > 0, F.btrim(F.substring(text, colon + 1, F.length(text))))
    words = F.split(asked, r"\s+")
    first, second, third, n = F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.get(words, F.lit(2)), F.size(words)
    # Two teams: what stands before and behind the word between them, without what a venue adds.
    between = F.instr(subject, VERSUS)
    behind = F.substring(subject, between + len(VERSUS), F.length(subject))
    behind = F.when(F.startswith(behind, F.lit(". ")), F.substring(behind, F.lit(3), F.length(behind))).when(F.startswith(behind, F.lit(" ")), behind)
    team_b = F.btrim(F.substring_index(F.substring_index(behind, " on ", 1), LEAGUE, 1))
    team_a = F.btrim(F.substring(subject, F.lit(1), between - 1))
    teams = (between > 1) & (team_a != "") & (team_b != "")
    over = F.instr(text, BY_OVER)
    claim, amount = F.substring(text, F.lit(1), over - 1), F.split(F.substring(text, over + len(BY_OVER), F.length(text)), " ")
    margin = F.when((over > 0) & F.get(amount, F.lit(1)).isin("points", "points?") & (F.size(amount) == 2), _number(F.get(amount, F.lit(0))))
    wins = _without(claim, (" wins the game", " wins"), end=True)
    half = _without(_without(claim, ("Will ",), end=False), (" win the 1H", " win the 2H"), end=True)
    spread = F.regexp_replace(F.element_at(words, -1), "^[(](.*)[)]$", "$1")
    favoured = F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), " ")
    least = F.when(F.endswith(first, F.lit("+")), _number(F.substring(first, F.lit(1), F.length(first) - 1)))

    def found(kind: str, line: Column | None = None, a: Column | None = None, b: Column | None = None, player: Column | None = None, prop: Column | None = None) -> Column:
        texts = {"team_a": a, "team_b": b, "player": player, "prop": prop}
        cells = [(F.lit(None).cast("string") if c is None else F.btrim(c)).alias(k) for k, c in texts.items()]
        return F.struct(F.lit(kind).alias("kind"), *cells, (F.lit(None).cast("double") if line is None else line).alias("line"))

    return (
        F.when(teams & (first == OVER_UNDER) & (n == 2) & _number(second).isNotNull(), found("total", _number(second), team_a, team_b))
        .when(~teams & (second == OVER_UNDER) & (n == 3) & _number(third).isNotNull(), found("player_line", _number(third), player=subject, prop=F.lower(first)))
        .when(~teams & least.isNotNull() & (n == 2), found("player_count", least - 0.5, player=subject, prop=F.lower(second)))
        .when((subject == "Spread") & (n > 1) & spread.rlike("^[+-]") & _number(spread).isNotNull(), found("spread", _number(spread), favoured))
        .when(asked.isNull() & wins.isNotNull() & margin.isNotNull(), found("margin", margin, wins))
        .when(asked.isNull() & half.isNotNull() & margin.isNotNull(), found("half_margin", margin, half))
        .when(teams, found("two_teams", None, team_a, team_b))
    )


def event_label(code: Column, labels: Mapping[int, str] = EVENTS) -> Column:
    """A label, never null: codes that aren't known keep their number."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(known[code], F.concat(F.lit("Event "), code.cast("string")), F.lit("Unknown"))


def row_set(payload: Column, name: str | None = None) -> Column:
    """Rows of a payload's named (or first) result set, each a map from header to value; a row that is shorter or
    longer than the headers counts as far as both go."""
    sets = F.from_json(payload, "resultSets array<struct<name:string,headers:array<string>,rowSet:array<array<string>>>>")["resultSets"]
    chosen = F.get(F.filter(sets, lambda x: x["name"] == name) if name else sets, F.lit(0))

    def as_map(row: Column) -> Column:
        n = F.least(F.size(row), F.size(chosen["headers"]))
        return F.map_from_arrays(F.slice(chosen["headers"], 1, n), F.slice(row, 1, n))

    return F.transform(chosen["rowSet"], as_map)


def choice(reply: Column, candidates: Column) -> Column:
    """The number a reply starts with, 0 for none of them; null where it names no candidate."""
    number = extract(reply, r"^\s*(-?[0-9]{1,9})").cast("int")
    return F.when(number.between(0, candidates), number)


#: Positions that stand before names, and words that aren't part of one (fixed values).
POSITIONS = ("G", "F", "C", "Gs", "Fs", "Cs", "G/F", "F/G", "F/C", "C/F", "G/C", "C/G")
NO_NAME = ("and", "as", "for", "from", "in", "off", "on", "to", "who", "with")


def player_after_position(text: Column) -> Column:
    """Two or three capitalised words right after the first position; null where there are fewer.

    One walk over the words: nothing counts before a position, and after it whatever isn't a name ends it, as a
    comma or full stop behind a word does.
    """
    start = F.struct(F.lit(0).alias("stage"), F.array().cast("array<string>").alias("name"))

    def walk(state: Column, word: Column) -> Column:
        bare = F.btrim(word, F.lit(".,;:()"))
        named = (state["stage"] == 1) & word.rlike(r"^\p{Lu}") & ~F.lower(bare).isin(*NO_NAME) & (F.size(state["name"]) < 3)
        stage = F.when(state["stage"] == 0, F.when(bare.isin(*POSITIONS), 1).otherwise(0)).when(named & ~word.rlike("[.,]$"), 1).otherwise(2)
        return F.struct(stage.alias("stage"), F.when(named, F.array_append(state["name"], bare)).otherwise(state["name"]).alias("name"))

    return F.aggregate(F.split(text, r"\s+"), start, walk, lambda s: F.when(F.size(s["name"]) >= 2, F.array_join(s["name"], " ")))


#: What a report lists a player as, and what its pages say (fixed values).
STATUSES = ("Out", "Doubtful", "Questionable", "Probable", "Available")
PENDING = "NOT YET SUBMITTED"
COLUMN_HEADER = "Game Date Game Time Matchup Team Player Name Current Status Reason"
PAGE_HEAD = "Injury Report:"
ENTRY = "reported_at string, game_date string, matchup string, team string, player string, status string, reason string, submitted boolean"


def typed_words(words: Sequence[str], phrases: Mapping[str, Mapping[tuple[str, ...], str]]) -> Iterator[tuple[str, str]]:
    """(kind, text) of each word, or of the longest known phrase that starts at it (``phrases``: by first word, then by
    all words, its kind)."""
    at = 0
    while at < len(words):
        known = phrases.get(words[at], {})
        best = max((p for p in known if tuple(words[at : at + len(p)]) == p), key=len, default=None)
        if best:
            yield known[best], " ".join(best)
            at += len(best)
            continue
        word = words[at]
        sides = word.split("@")
        if len(word) == 10 and word[2] == word[5] == "/" and word.replace("/", "").isdigit():
            yield "date", word
        elif len(sides) == 2 and all(2 <= len(s) <= 4 and s.isalpha() and s.isupper() for s in sides):
            yield "matchup", word
        else:
            yield "status" if word in STATUSES else "word", word
        at += 1


def listed_name(words: list[str]) -> tuple[str, int] | None:
    """A name at the end of ``words`` (surname, comma, one or two forenames; a surname may be two words with a hyphen
    between), as it is said, and where it starts."""
    letters = lambda w: bool(w) and w.replace("'", "").replace("\u2019", "").replace(".", "").replace("-", "").isalpha()
    for given in (1, 2):
        at = len(words) - given - 1
        if at < 0 or not words[at].endswith(",") or not all(letters(w) for w in words[at + 1 :]):
            continue
        surname, start = words[at][:-1], at
        while start and (words[start - 1].endswith("-") or surname.startswith("-")) and (letters(words[start - 1]) or words[start - 1] == "-"):
            start -= 1
            surname = words[start] + surname
        if letters(surname):
            return " ".join([*words[at + 1 :], surname]), start
    return None


class ReportReader:
    """Reads a report's words once, in order: dates, matchups and teams say where a player belongs, a status ends a
    name and starts a reason, and the reason ends where the next of these begins."""

    def __init__(self, teams: Sequence[str]):
        self.phrases: dict[str, dict[tuple[str, ...], str]] = {}
        for text, kind in [*((t, "team") for t in teams), (PENDING, "pending"), (COLUMN_HEADER, "header"), (PAGE_HEAD, "header")]:
            if phrase := tuple(text.split()):
                self.phrases.setdefault(phrase[0], {})[phrase] = kind

    def rows(self, text: str | None) -> Iterator[tuple]:
        words = (text or "").split()
        filed = next((words[i : i + 3] for i in range(2, len(words) - 2) if " ".join(words[i - 2 : i]) == PAGE_HEAD and words[i + 2] in ("AM", "PM")), None)
        if filed is None:
            return
        where = dict.fromkeys(("date", "matchup", "team"))
        player: tuple[str, str] | None = None
        held: list[str] = []

        def entry(name: str | None, status: str | None, reason: str, submitted: bool) -> tuple:
            return (" ".join(filed), *where.values(), name, status, reason.strip(" -;") or None, submitted)

        for kind, word in [*typed_words(words, self.phrases), ("end", "")]:
            if kind == "word" or kind == "status" and (where["team"] is None or not (name := listed_name(held))):
                held.append(word)
                continue
            # Whatever else it is, it ends the player before it; of a new player the name isn't the old one's reason.
            reason = held[: name[1]] if kind == "status" else held
            if player:
                yield entry(*player, " ".join(reason), True)
            player, held = ((name[0], word), []) if kind == "status" else (None, [])
            if kind == "pending" and where["team"]:
                yield entry(None, None, "", False)
            elif kind in where:
                where[kind] = word
                if kind == "matchup":
                    where["team"] = None  # another game's teams follow


def report_entries(reports: DataFrame, ident: str, text: str, teams: Sequence[str]) -> DataFrame:
    """A row for each player that a report lists, and for each team that hasn't filed (``submitted`` false).

    ``teams``: all names, a list that fits a task.  Texts without a filing time, and null ones, give no rows; players
    before the first team of a game neither, as whose they are would be a guess.
    """
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ReportReader(teams)
        for batch in batches:
            found = [(i, r) for i, t in enumerate(batch[text].to_pylist()) for r in reader.rows(t)]
            kinds = [pa.string()] * (len(names) - 1) + [pa.bool_()]
            cells = [pa.array([r[k] for _, r in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch[ident].take(pa.array([i for i, _ in found], pa.int64())), *cells], names=[ident, *names])

    return reports.select(ident, text).mapInArrow(rows, f"`{ident}` {reports.schema[ident].dataType.simpleString()}, {ENTRY}")
