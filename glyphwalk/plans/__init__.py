"""Plan helpers shared by all operators: lineage cuts, prefix sums, components."""
