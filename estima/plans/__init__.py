"""Orchestrated plans: training and scoring, and the catalog of registered queries."""

from estima.plans.train import TrainResult, checked_csv, train, train_csv  # noqa: F401
from estima.plans.predict import score  # noqa: F401
