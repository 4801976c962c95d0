"""An interactive session: stages stay cached until a change of settings touches them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

#: Later stages depend on all earlier ones; a setting names the first stage it changes.
STAGES = ("analysis", "segmentation", "geometry", "serialization")


class Session:
    """build: stage -> function(settings, frame of the stage before) -> frame."""

    def __init__(self, source: DataFrame, build: dict[str, Callable], touches: dict[str, str]) -> None:
        self.source, self.build, self.touches = source, build, touches
        self.settings: dict = {}
        self.kept: dict[str, DataFrame] = {}

    def first_changed(self, settings: dict) -> int:
        """Index of the earliest stage that the changed settings touch; unknown settings touch the first."""
        changed = {k for k in settings.keys() | self.settings.keys() if settings.get(k) != self.settings.get(k)}
        return min((STAGES.index(self.touches.get(k, STAGES[0])) for k in changed), default=len(STAGES))

    def update(self, settings: dict) -> DataFrame:
        """The last stage under new settings; untouched stages are not worked out again."""
        for stage in STAGES[self.first_changed(settings) :]:
            if stage in self.kept:
                self.kept.pop(stage).unpersist()
        self.settings, frame = dict(settings), self.source
        for stage in STAGES:
            if stage not in self.kept:
                self.kept[stage] = self.build[stage](self.settings, frame).persist()
            frame = self.kept[stage]
        return frame

    def close(self) -> None:
        while self.kept:
            self.kept.popitem()[1].unpersist()
