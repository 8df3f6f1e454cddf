"""Named queries over the test tables, with SQL for comparison."""
