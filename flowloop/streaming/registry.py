"""The models a running stream scores with."""

import logging

from flowloop.sources.models import USER, VALIDATED, ModelPair, ModelStore

log = logging.getLogger(__name__)

# Fixed value: micro-batches between two looks at the model store.
REFRESH_EVERY = 100


class ModelRegistry:
    """Holds both pairs on the driver and swaps each as a whole.

    The store is read on batch 0 and every ``refresh_every`` batches, and on any
    batch while there is no user pair, as after a restart. A failed load is
    logged and leaves the pair in use unchanged.
    """

    def __init__(self, store: ModelStore, refresh_every: int = REFRESH_EVERY):
        self.store = store
        self.refresh_every = refresh_every
        self.user: ModelPair | None = None
        self.validated: ModelPair | None = None

    def _newer(self, name: str, current: ModelPair | None) -> ModelPair | None:
        try:
            version = self.store.latest(name)
            if version is None or (current is not None and version == current.version):
                return current
            return self.store.load(name, version)
        except Exception as error:  # any failure keeps the pair that works
            log.warning("unable to load %s models: %s", name, error)
            return current

    def refresh(self) -> None:
        self.user = self._newer(USER, self.user)
        self.validated = self._newer(VALIDATED, self.validated)

    def for_batch(self, batch_id: int) -> tuple[ModelPair, ModelPair | None]:
        if batch_id % self.refresh_every == 0 or self.user is None:
            self.refresh()
        if self.user is None:
            # Failing keeps the batch for the next start; skipping would lose it.
            raise RuntimeError(f"no user models under {self.store.root}")
        return self.user, self.validated
