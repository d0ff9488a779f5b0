"""Topic taxonomies from text-rich networks, and corpus operators, on Spark DataFrames."""
