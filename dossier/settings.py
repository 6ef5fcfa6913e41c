"""Job parameters, passed explicitly to the stages that need them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class JobSettings:
    fast_model: str = "gpt-3.5-turbo-16k"
    smart_model: str = "gpt-4"
    temperature: float = 1.0
    max_tokens_cap: int = 8001
    chunk_chars: int = 8192
    hits_per_query: int = 4
    links_per_page: int = 5
    # Inference: tasks that call at once (None: as many as the cluster runs), calls that each
    # keeps open, and parts in which a list of calls is made.
    tasks: int | None = None
    threads: int = 1
    waves: int = 1
    # Tries of a call in one run, seconds before the second (doubled each time), and failed tries in all
    # after which it is a dead letter.
    attempts: int = 1
    pause: float = 1.0
    give_up: int | None = None

    @property
    def calling(self) -> dict:
        names = ("tasks", "threads", "waves", "attempts", "pause", "give_up")
        return {name: getattr(self, name) for name in names}


DEFAULTS = JobSettings()
