"""Imports every module that registers queries."""

import grainmill.plans.queries_metrics  # noqa: F401
import grainmill.plans.queries_corpus  # noqa: F401
import grainmill.plans.queries_joins  # noqa: F401
import grainmill.plans.queries_fits  # noqa: F401
import grainmill.plans.queries_comparison  # noqa: F401
import grainmill.plans.queries_samples  # noqa: F401
import grainmill.plans.queries_evidence  # noqa: F401
import grainmill.plans.queries_batches  # noqa: F401
import grainmill.plans.queries_streams  # noqa: F401
import grainmill.plans.queries_archives  # noqa: F401
import grainmill.plans.queries_views  # noqa: F401
import grainmill.plans.queries_calibration  # noqa: F401
import grainmill.plans.queries_records  # noqa: F401
