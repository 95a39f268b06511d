"""The named jobs. ``load`` imports every module that registers some."""


def load() -> None:
    from driftwise.plans import (  # noqa: F401
        cause_jobs,
        diagnosis_jobs,
        series_jobs,
        text_jobs,
    )
