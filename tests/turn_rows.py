"""What fixtures and tests of turns share. A module of its own, as `conftest` names several."""

import datetime as dt

TURN = "meeting_id long, turn long, speaker string, text string, started_at timestamp, ended_at timestamp"


def at(clock: str) -> dt.datetime:
    """A time on the day all fixtures share."""
    return dt.datetime.fromisoformat(f"2024-05-06 {clock}")
