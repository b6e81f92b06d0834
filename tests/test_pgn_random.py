"""Randomised PGN round trip: generated records -> bz2 text -> Spark parse,
against values computed in plain Python."""

import bz2
from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from elotrail.sources.pgn import encode_games, parse_tags, read_pgn

EVENTS = ["Rated Blitz game", "Rated Bullet game", "Rated UltraBullet game",
          "Rated Rapid game", "Rated Standard game", "Rated Classical game",
          "Rated Correspondence game", "Casual Chess960 game", "Rated Bughouse game"]


def event_code(e):
    e = e.lower()
    for sub, code in (("bullet", "b"), ("blitz", "B"), ("standard", "R"), ("rapid", "R"),
                      ("classical", "c"), ("correspondence", "C")):
        if sub in e:
            return code
    return "?"


rating = st.one_of(st.integers(600, 3300).map(str), st.just("?"), st.just("1500?"))
diff = st.one_of(st.integers(-60, 60).map(lambda d: f"{d:+d}"), st.just("?"))
game = st.fixed_dictionaries({
    "event": st.sampled_from(EVENTS),
    "white": st.from_regex(r"[A-Za-z0-9_-]{2,20}", fullmatch=True),
    "result": st.sampled_from(["1-0", "0-1", "1/2-1/2", "*"]),
    "ts": st.datetimes(datetime(2013, 1, 1), datetime(2018, 12, 31)).map(
        lambda d: d.replace(microsecond=0)),
    "welo": rating, "wdiff": diff,
    "tc": st.one_of(st.tuples(st.integers(0, 10800), st.integers(0, 180))
                    .map(lambda t: f"{t[0]}+{t[1]}"), st.sampled_from(["-", "600"])),
    "title": st.one_of(st.none(), st.sampled_from(["GM", "BOT", "IM"])),
    "term": st.sampled_from(["Normal", "Time forfeit", "Abandoned", "Rules infraction"]),
    "eval": st.booleans(),
})


def render(i, g):
    lines = [f'[Event "{g["event"]}"]', f'[Site "https://example.org/r{i:06d}"]',
             f'[White "{g["white"]}"]', '[Black "opponent"]', f'[Result "{g["result"]}"]',
             f'[UTCDate "{g["ts"]:%Y.%m.%d}"]', f'[UTCTime "{g["ts"]:%H:%M:%S}"]',
             f'[WhiteElo "{g["welo"]}"]', '[BlackElo "1500"]',
             f'[WhiteRatingDiff "{g["wdiff"]}"]', '[BlackRatingDiff "-3"]']
    if g["title"]:
        lines.append(f'[WhiteTitle "{g["title"]}"]')
    lines += ['[ECO "C20"]', f'[TimeControl "{g["tc"]}"]', f'[Termination "{g["term"]}"]']
    moves = "1. e4 { [%eval 0.3] } e5 " if g["eval"] else "1. e4 e5 "
    return "\n".join(lines) + "\n\n" + moves + g["result"] + "\n\n"


def expected(g):
    def num(x):
        return None if "?" in x else int(x)
    base_inc = g["tc"].split("+")
    tc = int(base_inc[0]) + 40 * int(base_inc[1]) if len(base_inc) == 2 else 0
    return {"event": event_code(g["event"]), "white_name": g["white"],
            "result": {"1-0": "W", "0-1": "B", "1/2-1/2": "D"}.get(g["result"], "?"),
            "whiteelo": num(g["welo"]), "whiteratingdiff": num(g["wdiff"]),
            "timecontrol": tc, "whitetitle": g["title"],
            "termination": {"Normal": "N", "Time forfeit": "F", "Abandoned": "A"}.get(
                g["term"], "?"),
            "analyzed": g["eval"], "date_time": g["ts"]}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(game, min_size=1, max_size=120))
def test_random_records_round_trip(spark, tmp_path_factory, games):
    d = tmp_path_factory.mktemp("rand")
    half = len(games) // 2
    for j, chunk in enumerate((games[:half], games[half:])):
        text = "".join(render(j * 1000 + i, g) for i, g in enumerate(chunk))
        (d / f"part{j}.pgn.bz2").write_bytes(bz2.compress(text.encode()))
    got = {r["site"]: r.asDict() for r in encode_games(parse_tags(read_pgn(spark, str(d))))
           .collect()}
    assert len(got) == len(games)
    for j, chunk in enumerate((games[:half], games[half:])):
        for i, g in enumerate(chunk):
            row = got[f"r{j * 1000 + i:06d}"]
            want = expected(g)
            assert {k: row[k] for k in want} == want
