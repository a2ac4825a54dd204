"""Signal catalogue.  Importing the package fills the registry."""
from panelquant.signals import analyst, fundamental, market, volatility  # noqa: F401
from panelquant.signals.base import CLASSES, SignalContext, compute_signals, input_manifest  # noqa: F401
