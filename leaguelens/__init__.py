"""leaguelens: league analytics and data preparation expressed as Spark plans."""
