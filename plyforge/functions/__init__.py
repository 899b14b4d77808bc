"""Column functions; all native expressions unless a module says otherwise."""
