"""Imports every query module, which registers its queries."""

from workload import q_network  # noqa: F401
from workload import q_geometry  # noqa: F401
from workload import q_raster  # noqa: F401
from workload import q_morphology  # noqa: F401
from workload import q_streets  # noqa: F401
from workload import q_metrics  # noqa: F401
from workload import q_cities, q_samples  # noqa: F401

FLAGSHIP = "G13_street_graph_edges"
