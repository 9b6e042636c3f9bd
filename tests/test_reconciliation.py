"""Counts and missing rows of invoices against plain versions over random billing data, with null keys, repeats and a hot partner."""

import random
from datetime import date

import pytest

from billweave.operators import reconciliation
from tests.conftest import rows_of

MONTHS = [date(2024, m, 1) for m in (1, 2, 3)]


@pytest.fixture(scope="module")
def billing():
    """(invoices, lines, subscriptions, transactions) as tuples; partner 1 holds most of them."""
    chance = random.Random(11)
    partner = lambda: chance.choice([1, 1, 1, 2, 3, None])
    day = lambda: chance.choice(MONTHS).replace(day=chance.randint(1, 28))
    item = lambda: chance.choice([None, *range(12)])
    invoices = [(i, partner(), day()) for i in range(14)]
    lines = [(f"L{k}", chance.choice([*range(16), None]), partner(), item(), day(), day()) for k in range(40)]
    lines += lines[:4]
    subscriptions = [(k, partner(), item(), chance.choice(["Active", "active", "Cancelled", None]), day()) for k in range(40)]
    subscriptions += subscriptions[:3]
    transactions = [(f"T{k}", partner(), item(), chance.choice([day(), None])) for k in range(40)]
    return invoices, lines, subscriptions, transactions


@pytest.fixture(scope="module")
def frames(spark, billing):
    ddl = (
        "invoice_id long, partner_id long, invoice_date date",
        "line_id string, invoice_id long, partner_id long, completed_line_item_id long, start_period date, end_period date",
        "id long, partner_id long, completed_line_id long, status string, billing_cycle_start date",
        "transaction_id string, partner_id long, completed_line_item_id long, invoice_date date",
    )
    return [spark.createDataFrame(rows, d) for rows, d in zip(billing, ddl)]


def same_month(a, b):
    return a is not None and b is not None and (a.year, a.month) == (b.year, b.month)


def active(status):
    return status is not None and status.lower() == "active"


def of_one_invoice(invoice, billing):
    """(counts, missing subscriptions, transactions, lines) of one invoice, read row by row."""
    _, lines, subscriptions, transactions = billing
    number, partner, day = invoice
    own = [x for x in lines if x[1] == number]
    items = [x[3] for x in own if x[3] is not None]
    subs = sum(items.count(s[2]) for s in subscriptions)
    moves = sum(items.count(t[2]) for t in transactions)
    of_partner = lambda rows: [r for r in rows if partner is not None and r[1] == partner]
    partner_lines = [x for x in lines if partner is not None and x[2] == partner]
    due = [s for s in of_partner(subscriptions) if active(s[3]) and same_month(s[4], day) and s[2] is not None]
    in_month = [t for t in of_partner(transactions) if same_month(t[3], day)]
    missing_subs = [s for s in due if s[2] not in items] if subs else []
    missing_moves = [t for t in in_month if t[2] not in items] if moves else []
    missing_lines = [x for x in partner_lines if x[0] not in {o[0] for o in own}] if own else []
    counts = (
        number, partner, day.replace(day=1), len(own), subs, moves, min((x[4] for x in own), default=None), max((x[5] for x in own), default=None),
        len({x[0] for x in partner_lines}), len(of_partner(subscriptions)), sum(active(s[3]) for s in of_partner(subscriptions)),
        len(of_partner(transactions)), len({s[2] for s in due}), len({s[2] for s in missing_subs}), len(missing_moves),
        len({x[0] for x in partner_lines}) - len({x[0] for x in own}) if own else 0,
    )
    return counts, missing_subs, missing_moves, missing_lines


def test_counts_of_every_invoice(billing, frames):
    got = rows_of(reconciliation.reconcile_invoices(*frames))
    assert got == sorted((of_one_invoice(i, billing)[0] for i in billing[0]), key=repr)
    assert any(r[13] for r in got) and any(r[14] for r in got)


@pytest.mark.parametrize("number", [0, 3, 5, 8, 11])
def test_rows_that_one_invoice_misses(billing, frames, number):
    invoices, lines, subscriptions, transactions = frames
    one = invoices.filter(invoices.invoice_id == number)
    _, subs, moves, left = of_one_invoice(billing[0][number], billing)
    assert rows_of(reconciliation.missing_subscriptions(one, lines, subscriptions)) == sorted(subs, key=repr)
    assert rows_of(reconciliation.missing_transactions(one, lines, transactions)) == sorted(moves, key=repr)
    assert rows_of(reconciliation.missing_lines(one, lines)) == sorted(left, key=repr)


def test_rows_that_all_invoices_miss(billing, frames):
    invoices, lines, subscriptions, transactions = billing
    partner_of = {i[0]: i for i in invoices}
    on = {(partner_of[x[1]][1], partner_of[x[1]][2].month, x[3]) for x in lines if x[1] in partner_of}
    sub_items, move_items = {s[2] for s in subscriptions} - {None}, {t[2] for t in transactions} - {None}
    shows_subs = {(p, m) for p, m, i in on if i in sub_items and p is not None}
    shows_moves = {(p, m) for p, m, i in on if i in move_items and p is not None}
    subs = [s for s in subscriptions if active(s[3]) and s[2] is not None and (s[1], s[4].month) in shows_subs and (s[1], s[4].month, s[2]) not in on]
    moves = [
        t for t in transactions
        if t[3] is not None and (t[1], t[3].month) in shows_moves and (t[2] is None or (t[1], t[3].month, t[2]) not in on)
    ]
    assert subs and moves
    assert rows_of(reconciliation.missing_subscriptions(frames[0], frames[1], frames[2])) == sorted(subs, key=repr)
    assert rows_of(reconciliation.missing_transactions(frames[0], frames[1], frames[3])) == sorted(moves, key=repr)
    held = {(partner_of[x[1]][1], x[0]) for x in lines if x[1] in partner_of}
    left = [x for x in lines if x[2] in {p for p, _ in held} - {None} and (x[2], x[0]) not in held]
    assert rows_of(reconciliation.missing_lines(frames[0], frames[1])) == sorted(left, key=repr)


def test_nothing_to_reconcile(frames):
    empty = [f.limit(0) for f in frames]
    assert reconciliation.reconcile_invoices(*empty).count() == 0
    assert reconciliation.missing_subscriptions(empty[0], frames[1], frames[2]).count() == 0
    bare = reconciliation.reconcile_invoices(frames[0], *empty[1:])
    assert bare.count() == 14 and bare.filter("line_count + missing_subscriptions + missing_transactions + missing_line_items > 0").count() == 0
