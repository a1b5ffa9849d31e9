"""The ``messages`` view (S1) derived from the driver's ``events`` table.

The provided tables hold almost no threat signals, so each event becomes a
message whose text is picked by arithmetic on its keys from a fixed set of
templates: the sample messages, benign text and the edge cases the rules must
get right (duplicate links, user info in URLs, bad brackets, trailing dots,
typosquats scoring 100, bare @handles, 13-digit ids, cards, screenshots...).

The view is written as SQL expressions that Spark SQL and DuckDB both accept
(``||``, ``CASE``, ``%``, ``lpad``, ``CAST(... AS STRING)``; no backslashes,
no quotes inside literals), so the Spark job and the DuckDB oracle read the
very same messages. It is a pure projection of ``events``: its size grows with
the table and it adds no shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import constants as C
from ..functions.rule import let
from .tables import deal, read_table

N_TEMPLATES = 30

_ID = "CAST(event_id AS STRING)"
_U = "CAST(user_id AS STRING)"
_BRAND = ("(CASE event_id % 7 WHEN 0 THEN 'paypal' WHEN 1 THEN 'netflix' WHEN 2 THEN 'amazon' "
          "WHEN 3 THEN 'dhl' WHEN 4 THEN 'chase' WHEN 5 THEN 'apple' ELSE 'coinbase' END)")
_TLD = ("(CASE event_id % 5 WHEN 0 THEN 'xyz' WHEN 1 THEN 'com' WHEN 2 THEN 'live' "
        "WHEN 3 THEN 'net' ELSE 'top' END)")


def _lit(s: str) -> str:
    assert "'" not in s and "\\" not in s, s
    return f"'{s}'"


def _samples() -> dict[str, str]:
    return {name: text for name, _, _, text in C.SAMPLES}


def _templates() -> list[str]:
    s = _samples()
    return [
        _lit(s["courier"]),                                                     # 0
        _lit(s["bank"]),                                                        # 1
        _lit(s["lottery"]),                                                     # 2
        _lit(C.QR_MESSAGE),                                                     # 3
        _lit(s["romance"]),                                                     # 4
        f"'Your ' || {_BRAND} || ' account is suspended. Verify at https://' || {_BRAND}"
        f" || '-secure-' || {_ID} || '.' || {_TLD} || '/login immediately.'",   # 5
        f"'Hi team, the report for order ' || {_ID} || ' is attached. See you at lunch.'",  # 6
        f"'Notes: www.example' || {_U} || '.com/notes and again www.example' || {_U}"
        f" || '.com/notes'",                                                    # 7
        f"'HTTP://CAPS-' || {_ID} || '.XYZ/pay now or call 202-555-'"
        f" || lpad(CAST(event_id % 10000 AS STRING), 4, '0')",                  # 8
        f"'Login at http://user:pw@host' || {_U} || '.io:80/p to keep your code'",  # 9
        f"'Broken https://[bad/x https://ex℀mple.com/x https://a＃b.io https://h：80.io and https://ok-'"
        f" || {_ID} || '.top here'",                                            # 10
        f"'Visit https://evil' || {_U} || '.xyz. Today only, your reward waits.'",  # 11
        f"'Invoice from paypal.co.uk: pay at https://paypal.co.uk/invoice/' || {_ID}",  # 12
        f"'Contact me @handle' || {_U} || ' for the refund'",                   # 13
        f"'Livraison café dhlé numéro ' || {_ID}",                              # 14
        f"'Your national id 4' || lpad({_ID}, 12, '0') || ' must be confirmed'",  # 15
        f"'Card 4111 1111 1111 ' || lpad(CAST(event_id % 10000 AS STRING), 4, '0')"
        f" || ' was charged, call +1 (202) 555-0199'",                          # 16
        f"'Write to support' || {_ID} || '@mail-' || {_U} || '.com for help'",  # 17
        f"'Payment code needed at https://paypa1-g00gle-' || {_ID} || '.xyz'",  # 18
        f"'URGENT: PayPal account blocked, verify your card at https://paypa1-secure-login-'"
        f" || {_ID} || '.xyz/'",                                                # 19
        "'my dear friend, keep this secret until we meet'",                     # 20
        "NULL",                                                                 # 21 screenshot
        "'\u00a0 \u2003'",                                                       # 22 rejected: blanks only
        f"'Quick question about ' || {_BRAND} || ' at www.' || {_BRAND} || '.com'",  # 23
        f"'Urgent: claim your reward, login at https://amaz0n-prize-' || {_ID} || '.xyz'",  # 24
        f"'Lunch at 12:30, table for ' || {_U} || '. Thanks!'",                 # 25
        f"'Scan your parcel label at www.royal-mail-' || {_U} || '.club/track'",  # 26
        f"'Bank of America alert: wire transfer pending, sign in at https://bankofamerica-'"
        f" || {_U} || '.support'",                                              # 27
        "'typed text is replaced by the screenshot'",                           # 28
        "NULL",                                                                 # 29 screenshot
    ]


def _case(selector: str, branches: list[str], default: str = "NULL", first: int = 0) -> str:
    whens = " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(branches, first))
    return f"CASE {selector} {whens} ELSE {default} END"


_MARKER = ("(CASE user_id % 6 WHEN 0 THEN 'FIXTURE_BANK_SCREENSHOT' "
           "WHEN 1 THEN 'FIXTURE_COURIER_SCREENSHOT' WHEN 2 THEN 'FIXTURE_LOTTERY_SCREENSHOT' "
           "WHEN 3 THEN 'FIXTURE_ROMANCE_SCREENSHOT' WHEN 4 THEN 'FIXTURE_QR_SCREENSHOT' "
           "ELSE 'PLAIN_SCREENSHOT' END)")


_PICK = f"event_id % {N_TEMPLATES}"


def view_columns() -> list[tuple[str, str]]:
    """(name, SQL expression) over ``events``, shared by Spark and the oracle."""
    t = _PICK
    image = (f"CASE WHEN {t} = 21 THEN 'data:image/png;base64,' || {_MARKER} "
             f"WHEN {t} = 28 THEN 'data:image/png;base64,FIXTURE_ROMANCE_SCREENSHOT' "
             f"WHEN {t} = 29 THEN 'data:image/png;base64,iVBORcardscan' || {_ID} "
             f"ELSE NULL END")
    situation = ("CASE WHEN event_id % 30 = 23 THEN 'curious' ELSE "
                 "(CASE user_id % 3 WHEN 0 THEN 'before_click' WHEN 1 THEN 'clicked_only' "
                 "ELSE 'compromised' END) END")
    return [
        ("msg_id", "event_id"),
        ("ts", "ts"),
        ("user_id", "user_id"),
        ("event_type", "event_type"),
        ("source", "CASE (event_id + user_id) % 3 WHEN 0 THEN 'SMS' WHEN 1 THEN 'Email' "
                   "ELSE 'Chat' END"),
        ("text", _case(t, _templates())),
        ("situation", situation),
        ("image", image),
        ("mime_type", f"CASE WHEN {t} IN (21, 28, 29) THEN 'image/png' ELSE NULL END"),
        ("demo_offline", "(event_id % 11 = 0)"),
    ]


def view_sql(events_table: str = "events") -> str:
    cols = ",\n  ".join(f"{expr} AS {name}" for name, expr in view_columns())
    return f"SELECT\n  {cols}\nFROM {events_table}"


def view(events: DataFrame) -> DataFrame:
    """The view's columns over events. A text's template is picked inside a lambda: as plain
    expressions, in the filter of the intake and again behind it, the templates make one generated
    method beyond the 8,000 bytes that the JVM compiles."""
    texts = _templates()
    few = 6   # branches a CASE: a lambda walks their list from its start for each
    groups = " ".join(f"WHEN picked < {i + few} THEN {_case('picked', texts[i:i + few], first=i)}"
                      for i in range(0, len(texts), few))
    columns = dict(view_columns()) | {"text": let("picked", _PICK, f"CASE {groups} END")}
    return events.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def messages(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    events = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    return view(deal(events) if dealt else events)
