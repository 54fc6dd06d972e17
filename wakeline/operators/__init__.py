"""DataFrame operators over position reports, intervals and contributions."""
