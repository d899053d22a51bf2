"""The golden change histories and a brute-force replay of their join."""

from datetime import date


def day(text):
    month, d = text.split("-")
    return date(2026, int(month), int(d))


# Golden rows of the temporal join.
ISSUES_SCHEMA = "issue_key string, changed_at date, status string, story_points int, component_key string"
COMPONENTS_SCHEMA = "component_key string, changed_at date, safety_class string, owner_team string"

ISSUES = [
    ("PA-1", day("06-10"), "To Do", 5, "C-NAV"),
    ("PA-1", day("06-14"), "In Progress", 5, "C-NAV"),
    ("PA-1", day("06-18"), "In Progress", 8, "C-PWR"),
    ("PA-1", day("06-22"), "Done", 8, "C-PWR"),
    ("PA-2", day("06-11"), "To Do", 3, None),
    ("PA-2", day("06-15"), "Done", 3, None),
    ("PA-3", day("06-13"), "To Do", 2, "C-CAB"),
    ("PA-4", day("06-10"), "To Do", 1, "C-NAV"),
    ("PA-4", day("06-12"), "Done", 1, "C-NAV"),
    ("PA-4", day("06-14"), "To Do", 1, "C-NAV"),
]
COMPONENTS = [
    ("C-NAV", day("06-09"), "B", "Navigation"),
    ("C-NAV", day("06-16"), "C", "Navigation"),
    ("C-PWR", day("06-12"), "D", "Power"),
    ("C-PWR", day("06-20"), "D", "Power"),
    ("C-CAB", day("06-17"), "A", "Cabin"),
]
JOINED = [
    ("PA-1", day("06-10"), "To Do", 5, "C-NAV", "B", "Navigation"),
    ("PA-1", day("06-14"), "In Progress", 5, "C-NAV", "B", "Navigation"),
    ("PA-1", day("06-16"), "In Progress", 5, "C-NAV", "C", "Navigation"),
    ("PA-1", day("06-18"), "In Progress", 8, "C-PWR", "D", "Power"),
    ("PA-1", day("06-22"), "Done", 8, "C-PWR", "D", "Power"),
    ("PA-2", day("06-11"), "To Do", 3, None, None, None),
    ("PA-2", day("06-15"), "Done", 3, None, None, None),
    ("PA-3", day("06-13"), "To Do", 2, "C-CAB", None, None),
    ("PA-3", day("06-17"), "To Do", 2, "C-CAB", "A", "Cabin"),
    ("PA-4", day("06-10"), "To Do", 1, "C-NAV", "B", "Navigation"),
    ("PA-4", day("06-12"), "Done", 1, "C-NAV", "B", "Navigation"),
    ("PA-4", day("06-14"), "To Do", 1, "C-NAV", "B", "Navigation"),
    ("PA-4", day("06-16"), "To Do", 1, "C-NAV", "C", "Navigation"),
]


def replay(lefts, rights, matches):
    """(key, ts, left row, right row) by the definition; rows are (key, ts, *values) and
    (link, ts, *values), `matches(left row, right row)` is the join condition."""
    out = []
    for key in sorted({r[0] for r in lefts}):
        own = sorted((r for r in lefts if r[0] == key), key=lambda r: r[1])
        ticks = {r[1] for r in own}
        ticks |= {r[1] for r in rights if any(matches(o, r) for o in own)}
        previous = None
        for tick in sorted(ticks):
            current = [r for r in own if r[1] <= tick]
            if not current:
                continue
            lhs = current[-1]
            seen = [r for r in rights if matches(lhs, r) and r[1] <= tick]
            rhs = max(seen, key=lambda r: r[1]) if seen else None
            state = (lhs[2:], rhs and (rhs[0], *rhs[2:]))
            if state != previous:
                out.append((key, tick, lhs, rhs))
            previous = state
    return out
