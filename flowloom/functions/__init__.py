"""Per-query kernels: pure functions over a Net, run inside grouped or mapped Arrow tasks."""
