"""weirgate: flow analytics and intrusion detection as Spark jobs."""
