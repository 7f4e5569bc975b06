"""Job options and their allowed ranges."""

from __future__ import annotations

from dataclasses import dataclass, field

# Hard limits of the callback format.
MAX_ATTEMPTS_LIMIT = 50
MAX_TIMEOUT_SECONDS = 300
MAX_EXTERNAL_TIMEOUT_SECONDS = 604_800
MAX_BACKOFF_SECONDS = 604_800
MAX_COMPLETION_CYCLES = 1_000
MAX_CALLBACKS_LIMIT = 1_000
MIN_PAYLOAD_LIMIT = 1_024
MAX_PAYLOAD_LIMIT = 104_857_600
MIN_SWEEP_INTERVAL = 10
MIN_RETENTION_INTERVAL = 60
MAX_RETENTION_BATCH = 10_000
MIN_STATS_INTERVAL = 10

# Defaults used where a callback leaves a field out.
DEFAULT_BACKOFF = (30, 120, 600, 3_600, 21_600, 86_400)
FALLBACK_BACKOFF_SECONDS = 60

# Byte limit of last_error.
ERROR_BYTES = 4_096

JITTER_MODES = ("none", "hash", "rand")


class OptionsError(ValueError):
    """Carries every problem found, not only the first."""

    def __init__(self, problems: list[str]):
        self.problems = problems
        super().__init__(f"{len(problems)} invalid option(s): " + "; ".join(problems))


@dataclass(frozen=True)
class Options:
    """Fan-out and dispatch options. Limits set to ``None`` mean the whole backlog."""

    poll_interval_seconds: int = 5
    batch_size: int | None = 50
    schedule_batch_size: int | None = 500
    dispatch_concurrency: int = 16
    max_attempts: int = 6
    backoff: tuple[int, ...] = DEFAULT_BACKOFF
    timeout_seconds: int = 30
    lock_buffer_seconds: int = 10
    sweep_interval_seconds: int = 60
    max_completion_cycles: int = 20
    payload_size_limit: int = 1_048_576
    max_callbacks_per_event: int = 32
    allow_insecure_urls: bool = False
    allow_unsigned_callbacks: bool = False
    allow_private_ip_targets: bool = False
    jitter: str = "hash"
    stats_interval_seconds: int = 30
    age_sample_limit: int | None = 1_000

    def __post_init__(self) -> None:
        problems: list[str] = []

        def check(ok: bool, text: str) -> None:
            if not ok:
                problems.append(text)

        def at_least(name: str, low: int, high: int | None = None, optional: bool = False) -> None:
            value = getattr(self, name)
            if value is None and optional:
                return
            check(value >= low, f"{name} must be >= {low}")
            if high is not None:
                check(value <= high, f"{name} must be <= {high}")

        at_least("poll_interval_seconds", 1)
        at_least("batch_size", 1, optional=True)
        at_least("schedule_batch_size", 1, optional=True)
        at_least("age_sample_limit", 1, optional=True)
        at_least("dispatch_concurrency", 1)
        at_least("max_attempts", 1, MAX_ATTEMPTS_LIMIT)
        at_least("timeout_seconds", 1, MAX_TIMEOUT_SECONDS)
        at_least("lock_buffer_seconds", 1)
        at_least("sweep_interval_seconds", MIN_SWEEP_INTERVAL)
        at_least("max_completion_cycles", 1, MAX_COMPLETION_CYCLES)
        at_least("payload_size_limit", MIN_PAYLOAD_LIMIT, MAX_PAYLOAD_LIMIT)
        at_least("max_callbacks_per_event", 1, MAX_CALLBACKS_LIMIT)
        at_least("stats_interval_seconds", MIN_STATS_INTERVAL)
        check(len(self.backoff) > 0, "backoff must contain at least one value")
        check(all(s > 0 for s in self.backoff), "backoff entries must all be > 0")
        check(
            all(s <= MAX_BACKOFF_SECONDS for s in self.backoff),
            f"backoff entries must all be <= {MAX_BACKOFF_SECONDS}",
        )
        check(self.jitter in JITTER_MODES, f"jitter must be one of {JITTER_MODES}")
        if problems:
            raise OptionsError(problems)


@dataclass(frozen=True)
class RetentionOptions:
    processed_days: int = 7
    dead_letter_days: int = 30
    cleanup_interval_seconds: int = 3_600
    batch_limit: int | None = 1_000

    def __post_init__(self) -> None:
        problems = []
        if self.processed_days < 1:
            problems.append("processed_days must be >= 1")
        if self.dead_letter_days < 1:
            problems.append("dead_letter_days must be >= 1")
        if self.cleanup_interval_seconds < MIN_RETENTION_INTERVAL:
            problems.append(f"cleanup_interval_seconds must be >= {MIN_RETENTION_INTERVAL}")
        if self.batch_limit is not None and not 1 <= self.batch_limit <= MAX_RETENTION_BATCH:
            problems.append(f"batch_limit must be between 1 and {MAX_RETENTION_BATCH}")
        if problems:
            raise OptionsError(problems)

    @property
    def longest_seconds(self) -> int:
        """Age beyond which no event is kept for its own sake."""
        return 86_400 * max(self.processed_days, self.dead_letter_days)


@dataclass(frozen=True)
class Page:
    """Keyset page: rows with an id below ``before``, newest first."""

    limit: int = 50
    before: int | None = None
    callback_name: str | None = None
    max_limit: int = field(default=200, repr=False)

    @property
    def rows(self) -> int:
        return max(1, min(self.limit, self.max_limit))
