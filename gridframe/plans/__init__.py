"""Domain jobs, driver-table stand-ins and the registered query set."""
